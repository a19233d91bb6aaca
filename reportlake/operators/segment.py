"""Ordered segmentation of a document: which line belongs to which stage.

One fold over the current lines of a document, written as a Catalyst
``aggregate``.  Its state has a fixed size for a given plan, whatever the length
of the document: the active stage, where each stage read its line or began and
ended, and at most two notes per stage.  (A position is added for each page whose
footer was itself read as a detail line.)  Only the grammar of the active stage is
tried on a line.  The lines of the sticky stage at the end, and those of repeating
stages whose test is quick, are marked once, before the fold, and picked by a plain
filter after it.

Lines are named by position in ``kept``.  The rules, for line ``L`` with
look-ahead ``N`` and active stage ``T``:

* ``T`` matches ``L``: read it; a single-line stage then gives way to the next.
* No match while tolerated lines are left: drop ``L`` silently.
* Single-line ``T`` and ``N`` matches in full: note a skipped line, read ``N``,
  pass both, go on with the next stage.
* Single-line ``T``, first failure: note it and stay.  Failure after an earlier
  one, lines read in between or not: note it, go on with the next stage and offer
  it ``L``.
* Repeating ``T``: go on with the next stage and offer it ``L``, then ``N``.

``N`` cannot be passed when no current line follows; reading then ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import cells
from reportlake.operators.lines import kept_lines, starts_page, with_lines
from reportlake.operators.staging import per_plan, stage
from reportlake.plans.grammar import ReportPlan

SKIPPED = "skipped_bad_line"
NO_MATCH = "no_match"
NEVER = 2**31 - 1

_NOTES = "array<struct<at:int,stage:int,kind:string>>"


class _Fold:
    """Builds the fold expression for a plan."""

    FIELDS = ["stage", "skips", "failed", "passing", "read", "low", "high", "passed", "quiet", "notes"]

    def __init__(self, plan: ReportPlan, kept: Column, current: Column) -> None:
        self.plan = plan
        self.n = len(plan.stages)
        self.kept = kept
        self.last = F.get(current, F.size(current) - 1)
        ends = [i for i in range(self.n) if i != plan.sticky]
        self.singles = [i for i in ends if not plan.stages[i].repeats]
        self.loops = [i for i in ends if plan.stages[i].repeats]

    def line(self, at: Column) -> Column:
        return F.get(self.kept, at)["l"]

    def is_footer(self, at: Column) -> Column:
        return starts_page(self.line(at + 1))

    def listed(self, acc: Column, at: Column) -> Column:
        """The active stage is a repeating one that goes on with a marked line: most lines of a list."""
        out = F.lit(False)
        for i in self.loops:
            if self.plan.stages[i].grammar.quick:
                out = out | ((acc["stage"] == i) & F.get(self.kept, at)[_mark_name(i)])
        return ~acc["passing"] & out

    def mark(self, at: Column, whole: bool = False) -> Column:
        return is_detail(self.plan, F.get(self.kept, at), whole)

    def per_stage(self, stage: Column, among: list[int], at: Column, whole: bool) -> Column:
        """A choice among the stages' tests, only the active one being evaluated."""
        out = F.when(F.lit(False), F.lit(False))
        for i in among:
            grammar = self.plan.stages[i].grammar
            if i == self.plan.sticky:
                test = self.mark(at, whole)
            else:
                test = (grammar.all_present if whole else grammar.matches)(self.line(at))
            out = out.when(stage == i, test)
        return out.otherwise(F.lit(False))

    def matches(self, stage: Column, at: Column, among: list[int]) -> Column:
        return self.per_stage(stage, among, at, whole=False)

    def full(self, stage: Column, at: Column, among: list[int]) -> Column:
        return self.per_stage(stage, among, at, whole=True)

    def after(self, stages: list[int]) -> list[int]:
        return [i + 1 for i in stages if i + 1 < self.n]

    def repeats(self, stage: Column) -> Column:
        marks = [i for i, s in enumerate(self.plan.stages) if s.repeats]
        return stage.isin(marks) if marks else F.lit(False)

    def skips(self, stage: Column) -> Column:
        marks = {i: s.skips for i, s in enumerate(self.plan.stages) if s.skips}
        out = F.lit(0)
        for i, count in marks.items():
            out = F.when(stage == i, F.lit(count)).otherwise(out)
        return out

    def zero(self) -> Column:
        empty = F.array_repeat(F.lit(-1), self.n)
        first_low = F.array(*[F.lit(0 if i == 0 else NEVER) for i in range(self.n)])
        return F.struct(
            F.lit(0).alias("stage"),
            F.lit(self.plan.stages[0].skips).alias("skips"),
            F.lit(False).alias("failed"),
            F.lit(False).alias("passing"),
            empty.alias("read"),
            first_low.alias("low"),
            F.array_repeat(F.lit(NEVER), self.n).alias("high"),
            F.array().cast("array<int>").alias("passed"),
            F.lit(0).alias("quiet"),
            F.array().cast(_NOTES).alias("notes"),
        )

    def state(self, acc: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(f, acc[f]).alias(f) for f in self.FIELDS])

    @staticmethod
    def put(values: Column, index: Column, value: Column) -> Column:
        return F.transform(values, lambda v, i: F.when(i == index, value).otherwise(v))

    @staticmethod
    def note(acc: Column, at: Column, stage: Column, kind: str) -> Column:
        entry = F.struct(at.alias("at"), stage.alias("stage"), F.lit(kind).alias("kind"))
        return F.concat(acc["notes"], F.array(entry))

    def enter(self, acc: Column, stage: Column, low: Column, **changes: Column) -> Column:
        """Make ``stage`` active; its ordinary lines begin at ``low``."""
        return self.state(
            acc,
            stage=stage,
            skips=self.skips(stage),
            low=self.put(acc["low"], stage, low),
            **{"failed": F.lit(False), **changes},
        )

    def read_next(self, acc: Column, stage: Column, at: Column, high: Column) -> Column:
        """``stage`` reads the look-ahead line; the following current line is passed."""
        notes = self.note(acc, at, stage, SKIPPED)
        read = self.put(acc["read"], stage, at + 1)
        then = F.when(self.repeats(stage), stage).otherwise(stage + 1)
        return F.when(
            at == self.last, self.state(acc, stage=F.lit(self.n), high=high, notes=notes)
        ).otherwise(
            self.enter(
                acc, then, F.lit(NEVER), passing=F.lit(True), read=read, high=high, notes=notes
            )
        )

    def offer(self, acc, stage, at, among, high, notes, miss) -> Column:
        """``stage`` has just become active on ``at``: read it, or do ``miss``."""
        return (
            F.when(stage >= self.n, self.state(acc, stage=F.lit(self.n), high=high, notes=notes))
            .when(
                self.matches(stage, at, among),
                F.when(
                    self.repeats(stage), self.enter(acc, stage, at, high=high, notes=notes)
                ).otherwise(
                    self.enter(
                        acc,
                        stage + 1,
                        at + 1,
                        read=self.put(acc["read"], stage, at),
                        high=high,
                        notes=notes,
                    )
                ),
            )
            .otherwise(miss)
        )

    def step(self, acc: Column, at: Column) -> Column:
        stage, nxt = acc["stage"], acc["stage"] + 1
        high = self.put(acc["high"], stage, at)
        no_match = self.note(acc, at, stage, NO_MATCH)

        entered_by_look_ahead = F.get(acc["low"], stage) == NEVER
        pass_over = F.when(
            entered_by_look_ahead,
            self.state(acc, passing=F.lit(False), low=self.put(acc["low"], stage, at + 1)),
        ).otherwise(
            self.state(acc, passing=F.lit(False), passed=F.concat(acc["passed"], F.array(at)))
        )

        after_single, after_loop = self.after(self.singles), self.after(self.loops)
        single = (
            F.when(self.full(stage, at + 1, self.singles), self.read_next(acc, stage, at, acc["high"]))
            .when(~acc["failed"], self.state(acc, failed=F.lit(True), notes=no_match))
            .otherwise(
                self.offer(
                    acc, nxt, at, after_single, acc["high"], no_match,
                    self.enter(acc, nxt, at + 1, notes=no_match),
                )
            )
        )
        repeating = self.offer(
            acc, nxt, at, after_loop, high, acc["notes"],
            F.when(self.full(nxt, at + 1, after_loop), self.read_next(acc, nxt, at, high)).otherwise(
                self.enter(acc, nxt, at + 1, high=high, notes=self.note(acc, at, nxt, NO_MATCH))
            ),
        )

        if self.plan.sticky is None:
            out = F.when(self.listed(acc, at), acc).when(stage >= self.n, acc).when(acc["passing"], pass_over)
        else:
            # Only footers read by look-ahead and tolerated lines need the fold.
            in_table = stage == self.plan.sticky
            plain = ~acc["passing"] & (acc["skips"] == 0) & (~F.col("has_feed") | ~self.is_footer(at + 1))
            table = (
                F.when(self.mark(at), acc)
                .when(acc["skips"] > 0, self.state(acc, skips=acc["skips"] - 1, quiet=at + 1))
                .when(
                    (at != self.last) & self.mark(at + 1, whole=True),
                    self.state(acc, passing=F.lit(True)),
                )
                .otherwise(acc)
            )
            out = (
                F.when(in_table & plain, acc)
                .when(self.listed(acc, at), acc)
                .when(stage >= self.n, acc)
                .when(acc["passing"], pass_over)
                .when(in_table, table)
            )
        return (
            out.when(
                self.matches(stage, at, self.singles + self.loops),
                F.when(self.repeats(stage), acc).otherwise(
                    self.enter(
                        acc,
                        nxt,
                        at + 1,
                        failed=acc["failed"],
                        read=self.put(acc["read"], stage, at),
                    )
                ),
            )
            .when(acc["skips"] > 0, self.state(acc, skips=acc["skips"] - 1))
            .when(self.repeats(stage), repeating)
            .otherwise(single)
        )


@per_plan
def _fold(plan: ReportPlan) -> Column:
    fold = _Fold(plan, F.col("kept"), F.col("current"))
    return F.aggregate(F.col("current"), fold.zero(), fold.step)


def _mark_name(stage: int) -> str:
    return f"matches_{stage}"


@per_plan
def _marked_lines(plan: ReportPlan, value: str) -> Column:
    """Kept lines, marked with whether they are lines of the sticky stage, and whether
    with all their fields; and of the repeating stages with a quick test."""
    marks = {
        _mark_name(i): s.grammar.matches
        for i, s in enumerate(plan.stages)
        if s.repeats and i != plan.sticky and s.grammar.quick
    }
    if plan.sticky is not None:
        marks["matches"] = plan.detail.grammar.matches
        if plan.detail.grammar.loose:
            marks["whole"] = plan.detail.grammar.all_present
    return kept_lines(F.col(value), **marks)


def with_segments(docs: DataFrame, plan: ReportPlan, value: str = "value") -> DataFrame:
    """``docs`` with ``kept``, ``current`` and the fold's result ``seg``."""
    return stage(with_lines(docs, value, _marked_lines(plan, value)), seg=_fold(plan))


def is_detail(plan: ReportPlan, entry: Column, whole: bool = False) -> Column:
    """The mark of a kept line, false past the end of the document."""
    mark = entry["whole"] if whole and plan.detail.grammar.loose else entry["matches"]
    return F.coalesce(mark, F.lit(False))


def line_at(position: Column) -> Column:
    """Text of a kept line, null for an absent position."""
    return F.when(position >= 0, F.get(F.col("kept"), position)["l"])


def read_position(stage: int) -> Column:
    """Position the stage read (single) or read by look-ahead (repeating); -1 if none."""
    return F.get(F.col("seg.read"), F.lit(stage))


def _span(stage: int) -> Column:
    """Current positions offered to a repeating stage, before its grammar is applied."""
    low, high = F.get(F.col("seg.low"), F.lit(stage)), F.get(F.col("seg.high"), F.lit(stage))
    bounds = F.struct(low.alias("low"), high.alias("high"))
    return cells.let(bounds, lambda b: F.filter(F.col("current"), lambda i: (i >= b["low"]) & (i < b["high"])))


def table_positions(plan: ReportPlan) -> Column:
    """Current positions offered to the sticky stage; lines passed over are not."""
    low, passed = F.get(F.col("seg.low"), F.lit(plan.sticky)), F.col("seg.passed")
    offered = cells.let(low, lambda begin: F.filter(F.col("current"), lambda i: i >= begin))
    return F.when(F.size(passed) == 0, offered).otherwise(F.array_except(offered, passed))


def _entry_of(position: Column) -> Column:
    return F.get(F.col("kept"), position)


def _run_of(low: Column, high: Column) -> Column:
    """Kept lines from ``low`` up to ``high``, of a document without page breaks: there all but the last are current."""
    kept = F.col("kept")
    return F.slice(kept, low + 1, F.greatest(F.least(high, F.size(kept) - 1) - low, F.lit(0)))


def _led_by(ahead: Column, lines: Column) -> Column:
    """``lines`` after the line a stage was entered with by look-ahead, if any."""
    return F.when(ahead >= 0, F.concat(F.array(_entry_of(ahead)), lines)).otherwise(lines)


@per_plan
def repeated_lines(plan: ReportPlan, stage: int) -> Column:
    """``array<struct<n, l, ...>>``: lines of a repeating stage that is not sticky, in order."""
    grammar = plan.stages[stage].grammar
    low, high = F.get(F.col("seg.low"), F.lit(stage)), F.get(F.col("seg.high"), F.lit(stage))
    whole = ~F.col("has_feed") & (low < F.size("kept"))
    lines = F.when(whole, _run_of(low, high)).otherwise(F.transform(_span(stage), _entry_of))
    test = (lambda x: x[_mark_name(stage)]) if grammar.quick else (lambda x: grammar.matches(x["l"]))
    return _led_by(read_position(stage), F.filter(lines, test))


@per_plan
def sticky_lines(plan: ReportPlan) -> Column:
    """``array<struct<n, l, ...>>``: lines the last stage read, in order.

    A footer counts when it was the look-ahead of a line that does not match.
    """
    kept, current = F.col("kept"), F.col("current")
    quiet, last = F.col("seg.quiet"), F.get(current, F.size(current) - 1)

    def footer(i: Column) -> Column:
        return (
            is_detail(plan, F.get(kept, i + 1), whole=True)
            & starts_page(F.get(kept, i + 2)["l"])
            & (i >= quiet)
            & (i != last)
        )

    lines = F.transform(
        table_positions(plan),
        lambda i: F.when(is_detail(plan, F.get(kept, i)), _entry_of(i)).when(
            footer(i), _entry_of(i + 1)
        ),
    )
    # without page breaks there are no footers, and no line of the table is passed over
    low = F.get(F.col("seg.low"), F.lit(plan.sticky))
    whole = ~F.col("has_feed") & (F.size("seg.passed") == 0) & (low < F.size("kept"))
    plain = F.filter(_run_of(low, F.size("kept")), lambda x: x["matches"])
    return _led_by(read_position(plan.sticky), F.when(whole, plain).otherwise(F.array_compact(lines)))
