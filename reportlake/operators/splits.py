"""Documents in several rows: for files that do not fit a row or a task.

A document comes as segments, rows of whole lines with a sortable number. What a segment must know
of its neighbours is exchanged in rows that hold no more than its border: how many lines and page
breaks came before, and its next two lines. Where stages are read, a segment also needs the state in
which the one before it ended. That chain is not followed one by one: each segment works out, for
every state it could be entered in, the one it would end in; these maps are composed in a tree over
the segments, and on the way down each segment learns the state it is really entered in.

The state is small whatever the document: the active stage, tolerated lines left, whether a line
failed before, and whether the next line has been read already. A line takes part as one number, which
says what grammars match it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reportlake.operators import diagnostics as events_of
from reportlake.operators.extract import (
    _bad_context,
    _head_name,
    _header,
    _list_name,
    _loops,
    _parsed_lines,
    _singles,
    context_values,
    has_required,
)
from reportlake.operators.lines import kept_lines, starts_page
from reportlake.operators.numbering import numbered, running_totals
from reportlake.operators.segment import NO_MATCH, SKIPPED, line_at, read_position
from reportlake.operators.staging import stage
from reportlake.plans.grammar import FILE_FIELD, ReportPlan, default_plan
from reportlake.session import shared_folder

SEGMENT = "segment"
#: Kinds of what a stage says of a line, besides those of diagnostics.
READ, ENTERED, DAMAGED, TABLE = "read", "entered", "damaged", "table "
#: Bytes of border rows that are broadcast at most; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Segments whose state maps are composed at a time.
FAN_IN = 64
#: Neighbouring small segments that are read as one, and the most characters of what that gives.
TOGETHER, TOGETHER_LENGTH = 16, 1 << 20


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut_documents(docs: DataFrame, lines: int, key: str = "doc_id", value: str = "value") -> DataFrame:
    """Documents that are whole rows, cut into segments of so many lines."""
    # staged: inside the lambda the whole document would be split again for every segment
    docs = stage(docs.select(key, value), _cut=F.split(value, "\n"))
    parts = F.transform(
        F.sequence(F.lit(1), F.size("_cut"), F.lit(lines)), lambda i: F.array_join(F.slice("_cut", i, F.lit(lines)), "\n")
    )
    return docs.select(key, F.posexplode(parts).alias(SEGMENT, value)).withColumn(SEGMENT, F.col(SEGMENT).cast("long"))


def _together(segments: DataFrame, key: str, value: str) -> DataFrame:
    """Segments of which small neighbours are put together: borders and maps cost the same for a line as for many.

    Only numbers that follow each other without a gap or repeat are joined; any other segment stays as it is.
    """
    rows = segments.select(key, SEGMENT, value)
    if TOGETHER < 2 or rows.schema[SEGMENT].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return rows
    small = F.coalesce(F.char_length(value) <= TOGETHER_LENGTH // TOGETHER, F.lit(False))
    place = [F.when(small, F.floor(F.col(SEGMENT) / TOGETHER)).alias("_block"), F.when(~small, F.col(SEGMENT)).alias("_alone")]
    parts = F.sort_array(F.collect_list(F.struct(SEGMENT, value))).alias("parts")
    met = rows.select("*", *place).groupBy(key, "_block", "_alone").agg(parts)
    met = stage(met, numbers=F.transform("parts", lambda x: x[SEGMENT]))
    n, first = F.size("numbers"), F.get("numbers", F.lit(0))
    follow = (F.size(F.array_distinct("numbers")) == n) & (F.get("numbers", n - 1) - first == n - 1) & F.col("_block").isNotNull()
    whole = F.struct(first.alias(SEGMENT), F.array_join(F.transform("parts", lambda x: x[value]), "\n").alias(value))
    return met.select(key, F.inline(F.when(follow, F.array(whole)).otherwise(F.col("parts"))))


# --- Borders -----------------------------------------------------------------


def _small(side: DataFrame, size: Column) -> DataFrame:
    """A stored side, broadcast if its bytes are few; else Spark joins by shuffle."""
    total = side.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0]
    return F.broadcast(side) if total <= BROADCAST_BYTES else side


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys may be null; the side's other columns must be new."""
    side = side.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    same = [rows[k].eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return rows.join(side, same, how).drop(*[f"_on_{k}" for k in keys])


def with_borders(segments: DataFrame, key: str, head: Column, count: Column, feeds: Column, raw: Column) -> DataFrame:
    """Segments with lines_before, kept_before, feeds_before, and ``next``: up to two entries that follow.

    ``head`` holds the first two entries of a segment, ``count`` is the number of all, ``raw`` that of its
    lines and ``feeds`` that of entries that begin a page. A segment without entries has none to follow
    it. Only documents of several segments have border rows.
    """
    heads = segments.select(
        key, SEGMENT, raw.cast("long").alias("raw"), count.cast("long").alias("count"), feeds.cast("long").alias("feeds"), head.alias("head")
    )
    several = heads.groupBy(F.col(key).alias("_on")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heads = heads.join(several, heads[key].eqNullSafe(F.col("_on")), "left_semi")
    filled = (F.col("count") > 0).cast("long")
    names = {"_raw": F.col("raw"), "_count": F.col("count"), "_feeds": F.col("feeds"), "_filled": filled}
    # the heads of empty segments have nothing to tell but count as lines
    totals = _stored(running_totals(heads, [key], SEGMENT, names), "borders")
    own = totals.where("count > 0").select(key, "_filled", "head", F.col("_raw").alias("_end"), F.col("raw").alias("_len"))

    def ahead(by: int) -> DataFrame:
        entries = F.transform("head", lambda x: F.struct(x.alias("x"), (F.col("_end") - F.col("_len")).alias("lines")))
        return own.select(key, (F.col("_filled") - by).alias("_filled"), entries.alias(f"_ahead{by}"))

    met = _joined(_joined(totals, ahead(1), [key, "_filled"]), ahead(2), [key, "_filled"])
    none = F.array().cast(met.schema["_ahead1"].dataType)
    follow = F.slice(F.concat(F.coalesce("_ahead1", none), F.coalesce("_ahead2", none)), F.lit(1), F.lit(2))
    borders = _stored(
        met.select(
            key, SEGMENT,
            (F.col("_raw") - F.col("raw")).alias("lines_before"),
            (F.col("_count") - F.col("count")).alias("kept_before"),
            (F.col("_feeds") - F.col("feeds")).alias("feeds_before"),
            F.when(F.col("count") > 0, follow).otherwise(none).alias("next"),
        ),
        "borders",
    )
    size = F.coalesce(F.aggregate("next", F.lit(0), lambda n, x: n + F.length(F.to_json(x))), F.lit(0))
    out = _joined(segments, _small(borders, size), [key, SEGMENT])
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("lines_before", "kept_before", "feeds_before")}).withColumn(
        "next", F.coalesce("next", none)
    )


def explode_segments(segments: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """``lines(key, line_no, line, line_next, is_current, page_no)`` as of the whole documents.

    The result equals that of lines of unsplit documents. Segments are rows of ``key``, a number by
    which they are ordered (``segment``) and whole lines; a segment may be empty or hold one empty line.
    """
    cut = stage(segments.select(key, SEGMENT, value), kept=kept_lines(F.col(value)))
    feeds = F.size(F.filter("kept", lambda x: starts_page(x["l"])))
    met = with_borders(cut, key, F.slice("kept", F.lit(1), F.lit(2)), F.size("kept"), feeds, F.size(F.split(value, "\n")))
    entries = F.transform(
        "kept", lambda x, i: F.struct(x["n"].alias("n"), x["l"].alias("l"), i.alias("i"), starts_page(x["l"]).alias("feed"))
    )
    ahead = F.get("next", F.lit(0))["x"]["l"]
    met = stage(met, entries=entries, after=ahead)
    met = stage(met, marks=F.array_compact(F.transform("entries", lambda x: F.when(x["feed"], x["i"]))))

    def line(x: Column, i: Column) -> Column:
        begun = F.col("feeds_before") + F.size(F.filter("marks", lambda m: m <= i))
        follows = F.coalesce(F.get("entries", i + 1)["l"], F.when(i + 1 == F.size("entries"), F.col("after")))
        opening = begun == F.col("kept_before") + i + 1
        return F.struct(
            (F.col("lines_before") + x["n"]).alias("line_no"), x["l"].alias("line"), follows.alias("line_next"),
            (follows.isNotNull() & ~starts_page(follows) & ~opening).alias("is_current"), begun.cast("int").alias("page_no"),
        )

    return met.select(key, F.inline(F.transform("entries", line)))


# --- Stages ------------------------------------------------------------------


class _Machine:
    """The rules of :mod:`segment`, a line at a time, on what is known of lines.

    A code has, from its lowest bit, for each stage whether its grammar matches, for each stage whether
    with all fields, whether the line begins a page, and whether it has a mask.
    """

    def __init__(self, plan: ReportPlan):
        self.n, self.sticky = len(plan.stages), plan.sticky
        self.repeats = [s.repeats for s in plan.stages]
        self.skips = [s.skips for s in plan.stages]
        self.wide = plan.sticky is not None and plan.detail.grammar.wide
        self.numbers = {s: i for i, s in enumerate(self.states())}
        self.known: dict = {}

    @staticmethod
    def codes(plan: ReportPlan, line: Column) -> Column:
        n, total = len(plan.stages), F.lit(0)
        put = lambda test, bit: F.when(test, F.lit(1 << bit)).otherwise(F.lit(0))
        for i, step in enumerate(plan.stages):
            if step.grammar.loose:
                total = total + put(step.grammar.matches(line), i) + put(step.grammar.all_present(line), n + i)
            else:
                total = total + F.when(step.grammar.matches(line), F.lit(1 << i | 1 << n + i)).otherwise(F.lit(0))
        total = total + put(starts_page(line), 2 * n)
        if plan.sticky is not None and plan.detail.grammar.wide:
            total = total + put(line.contains("#"), 2 * n + 1)
        return total.cast("long")

    def start(self) -> tuple:
        return (0, self.skips[0], False, False)

    def states(self) -> list[tuple]:
        flags = (False, True)
        return [
            (s, k, failed, passing)
            for s in range(self.n + 1)
            for k in range((self.skips[s] if s < self.n else 0) + 1)
            for failed in flags
            for passing in flags
        ]

    def enter(self, s: int, failed: bool = False, passing: bool = False) -> tuple:
        return (min(s, self.n), self.skips[s] if s < self.n else 0, failed, passing)

    def step(self, state: tuple, here: int, ahead: int, footer: bool, last: bool) -> tuple:
        """The next state, and what happens: (line ahead or not, stage, kind), kind READ for a line read.

        ``footer``: the line ahead is followed by one that begins a page. What the last stage says of its
        own lines has a kind that begins with TABLE.
        """
        after, done = self._step(state, here, ahead, footer, last)
        if after[0] == self.sticky != state[0]:
            done = (*done, (0, self.sticky, ENTERED))
        return after, done

    def moves(self, line: tuple) -> tuple[list[int], list[tuple]]:
        """By the number of every state: that of the next one, and what happens, on a line of ``walk``."""
        if line not in self.known:
            steps = [self.step(state, *line) for state in self.numbers]
            self.known[line] = [self.numbers[after] for after, _ in steps], [done for _, done in steps]
        return self.known[line]

    def _read(self, s: int, here: int) -> tuple:
        damaged = here >> (2 * self.n + 1) & 1 if self.wide else not here >> (self.n + s) & 1
        own = ((0, s, READ),)
        return (*own, (0, s, TABLE + DAMAGED)) if s == self.sticky and damaged else own

    def _step(self, state, here, ahead, footer, last):
        s, skips, failed, passing = state
        if s >= self.n:
            return state, ()
        if passing:
            return (s, skips, failed, False), ()
        reads = lambda i: here >> i & 1
        whole = lambda i: ahead >> (self.n + i) & 1
        if s == self.sticky:
            return self._table(state, reads(s), whole(s), here, footer, last)
        if reads(s):
            return (state if self.repeats[s] else self.enter(s + 1, failed)), self._read(s, here)
        if skips:
            return (s, skips - 1, failed, False), ()
        if not self.repeats[s]:
            if whole(s):
                return self._read_next(s, last)
            miss = (0, s, NO_MATCH)
            if not failed:
                return (s, skips, True, False), (miss,)
            return self._offer(s + 1, here, (miss,)) or (self.enter(s + 1), (miss,))
        offered = self._offer(s + 1, here, ())
        if offered:
            return offered
        if whole(s + 1):
            return self._read_next(s + 1, last)
        return self.enter(s + 1), ((0, s + 1, NO_MATCH),)

    def _offer(self, s, here, notes):
        if s >= self.n:
            return self.enter(self.n), notes
        if here >> s & 1:
            return self.enter(s if self.repeats[s] else s + 1), (*notes, *self._read(s, here))
        return None

    def _read_next(self, s, last):
        note = (0, s, SKIPPED)
        if last:  # the line ahead cannot be passed
            return self.enter(self.n), (note,)
        return self.enter(s if self.repeats[s] else s + 1, passing=True), (note, (1, s, READ))

    def _table(self, state, match, whole, here, footer, last):
        s, skips, failed, _ = state
        if match:
            return state, self._read(s, here)
        if skips:
            return (s, skips - 1, failed, False), ()
        note = (0, s, TABLE + (SKIPPED if whole else NO_MATCH))
        if footer and not last and whole:
            return (s, skips, failed, True), (note, (1, s, READ))
        return state, (note,)

    def walk(self, codes: list[int], follow: list[int], opening: bool, later: bool) -> Iterator[tuple]:
        """The current lines of a segment: index, and (code here, code ahead, footer, last)."""
        feed = 1 << 2 * self.n
        every = codes + follow
        if not any([code & feed for code in every]):  # no page begins here
            n = min(len(codes), len(every) - 1)
            end = -1 if later else n - 1
            for i in range(n):
                yield i, (every[i], every[i + 1], False, i == end)
            return
        found = []
        for i in range(len(codes)):
            opening = opening and bool(codes[i] & feed)
            if i + 1 < len(every) and not every[i + 1] & feed and not opening:
                footer = i + 2 < len(every) and bool(every[i + 2] & feed)
                found.append((i, every[i], every[i + 1], footer))
        for j, (i, *line) in enumerate(found):
            yield i, (*line, j == len(found) - 1 and not later)

    def map(self, lines: Iterator[tuple]) -> list[int]:
        """The number of the state after these lines, by that of the one before them."""
        ends = list(range(len(self.numbers)))
        for _, line in lines:
            after, _ = self.moves(line)
            ends = [after[e] for e in ends]
        return ends


def _rows(column: pa.Array) -> list:
    """A column as Python values; lists of numbers are taken as one array, not one by one."""
    if not pa.types.is_list(column.type) or column.null_count:
        return column.to_pylist()
    flat = column.values.to_pylist() if column.values.null_count else column.values.to_numpy().tolist()
    ends = column.offsets.to_pylist()
    return [flat[a:b] for a, b in pairwise(ends)]


def _appended(df: DataFrame, inputs: list[str], function: Callable, name: str, kind: str) -> DataFrame:
    """``df`` with a column of lists worked out in Python from some others; the rest passes through unread."""
    out = StructType.fromDDL(f"`{name}` {kind}")
    fields = [("at", pa.int32()), ("stage", pa.int32()), ("kind", pa.string())] if "struct" in kind else []

    def run(batches):
        for batch in batches:
            found = [function(*r) for r in zip(*[_rows(batch.column(c)) for c in inputs])]
            ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
            flat = list(chain.from_iterable(found))
            if fields:
                parts = zip(*flat) if flat else [()] * len(fields)
                items = pa.StructArray.from_arrays([pa.array(p, t) for p, (_, t) in zip(parts, fields)], [n for n, _ in fields])
            else:
                items = pa.array(flat, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, items)], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema, *out]))


def _entered(maps: DataFrame, key: str, first: int) -> DataFrame:
    """The state each segment is entered in, from the state maps of all segments of a document.

    Maps are composed FAN_IN at a time, up to one for each document and down again.
    """
    levels = [_stored(numbered(maps, [key], SEGMENT, "k").withColumn("k", F.col("k") - 1), "maps")]
    most = levels[0].agg(F.max("k")).first()[0] or 0
    grouped = []
    while True:
        whole = levels[-1].withColumn("to", F.floor(F.col("k") / FAN_IN)).groupBy(key, "to").agg(
            F.sort_array(F.collect_list(F.struct("k", "map"))).alias("maps")
        )
        grouped.append(_stored(whole, "grouped"))
        most //= FAN_IN
        if most == 0:
            break
        composed = F.aggregate(
            F.slice("maps", F.lit(2), F.lit(FAN_IN)), F.get("maps", F.lit(0))["map"],
            lambda done, m: F.transform(done, lambda s: F.get(m["map"], s)),
        )
        levels.append(grouped[-1].select(key, F.col("to").alias("k"), composed.alias("map")))
    states = grouped[-1].select(key, F.col("to").alias("k"), F.lit(first).alias("state"))
    for groups in reversed(grouped):
        met = _joined(groups, states.withColumnRenamed("k", "to"), [key, "to"], "inner")

        def entry(x: Column, i: Column) -> Column:
            state = F.aggregate(F.slice("maps", F.lit(1), i), F.col("state"), lambda s, m: F.get(m["map"], s))
            return F.struct(x["k"].alias("k"), state.alias("state"))

        states = _stored(met.select(key, F.inline(F.transform("maps", entry))), "entries")
    return _joined(levels[0].select(key, SEGMENT, "k"), states, [key, "k"], "inner").select(key, SEGMENT, "state")


def read_stages(segments: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value") -> DataFrame:
    """``(key, line_no, line, line_next, stage, kind)``, stored: every line that a stage read (READ), and what
    there is to say of lines.

    Equal to what the fold over the whole document reads. Text is written once with its codes; everything
    else moves codes, borders and state maps.
    """
    return _read_stages(segments, plan or default_plan(), key, value)[0]


def _read_stages(segments: DataFrame, plan: ReportPlan, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """What ``read_stages`` gives, and the stored keys, so that the segments are worked out once."""
    machine = _Machine(plan)
    first = machine.numbers[machine.start()]
    n = len(plan.stages)
    coded = stage(_together(segments, key, value), kept=kept_lines(F.col(value), c=lambda l: _Machine.codes(plan, l)))
    coded = _stored(
        coded.select(
            key, SEGMENT, F.size(F.split(value, "\n")).alias("raw"),
            F.transform("kept", lambda x: x["n"]).alias("numbers"), F.transform("kept", lambda x: x["l"]).alias("texts"),
            F.transform("kept", lambda x: x["c"]).alias("codes"),
        ),
        "coded",
    )
    feed = F.lit(1 << 2 * n)
    head = lambda i: F.struct(F.get("numbers", F.lit(i)).alias("n"), F.get("texts", F.lit(i)).alias("l"), F.get("codes", F.lit(i)).alias("c"))
    heads = F.array_compact(F.array(*[F.when(F.size("codes") > i, head(i)) for i in (0, 1)]))
    feeds = F.size(F.filter("codes", lambda c: c.bitwiseAND(feed) != 0))
    light = coded.select(key, SEGMENT, "raw", "codes", heads.alias("heads"), feeds.alias("feeds"), F.size("codes").alias("count"))
    met = with_borders(light, key, F.col("heads"), F.col("count"), F.col("feeds"), F.col("raw"))
    own = met.select(key, SEGMENT, "codes", "next", "lines_before", (F.col("feeds_before") == F.col("kept_before")).alias("opening"))
    own = own.withColumn("follow", F.transform("next", lambda x: x["x"]["c"]))
    # a line is current if the next one begins no page; those that open the document are not
    fed = lambda c: c.bitwiseAND(feed) != 0
    after_feeds = F.array_position(F.transform("codes", fed), F.lit(False)).cast("int") - 1
    begin = F.when(~F.col("opening"), F.lit(0)).when(after_feeds < 0, F.size("codes")).otherwise(after_feeds)
    following = F.slice(F.concat("codes", F.slice("follow", F.lit(1), F.lit(1))), begin + 2, F.size("codes"))
    own = _stored(own.withColumn("has_current", F.exists(following, lambda c: ~fed(c))), "current")
    end = own.where("has_current").groupBy(F.col(key).alias("_on")).agg(F.max(SEGMENT).alias("_end"))
    own = own.join(end, own[key].eqNullSafe(F.col("_on")), "left")
    own = own.withColumn("later", F.coalesce(F.col(SEGMENT) < F.col("_end"), F.lit(False))).drop("_on", "_end")

    def mapped(codes, follow, opening, later):
        return machine.map(machine.walk(codes, follow, opening, later))

    several = own.groupBy(F.col(key).alias("_on")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = own.join(several, own[key].eqNullSafe(F.col("_on")), "left_semi")
    maps = _appended(parts.select(key, SEGMENT, "codes", "follow", "opening", "later"), ["codes", "follow", "opening", "later"], mapped, "map", "array<int>")
    # stored first: sorting by range reads its input twice
    entered = _entered(_stored(maps.select(key, SEGMENT, "map"), "mapped"), key, first)
    own = _joined(own, entered, [key, SEGMENT]).withColumn("state", F.coalesce("state", F.lit(first)))

    def run(codes, follow, opening, later, state):
        out, now = [], state
        for i, line in machine.walk(codes, follow, opening, later):
            after, done = machine.moves(line)
            out += [(i + on, s, kind) for on, s, kind in done[now]]
            now = after[now]
        return out

    own = own.drop("has_current")
    read = _appended(own, ["codes", "follow", "opening", "later", "state"], run, "done", "array<struct<at:int,stage:int,kind:string>>")
    # a segment that read nothing needs no text
    read = _stored(read.where(F.size("done") > 0).select(key, SEGMENT, "lines_before", "next", "done"), "done")
    met = _joined(coded.select(key, SEGMENT, "numbers", "texts"), read, [key, SEGMENT], "inner")
    beyond = lambda i: F.get("next", i - F.size("texts"))

    def line(x: Column) -> Column:
        inside = x["at"] < F.size("texts")
        at, then = x["at"], x["at"] + 1
        return F.struct(
            F.when(inside, F.get("numbers", at) + F.col("lines_before")).otherwise(beyond(at)["x"]["n"] + beyond(at)["lines"]).alias("line_no"),
            F.when(inside, F.get("texts", at)).otherwise(beyond(at)["x"]["l"]).alias("line"),
            F.when(then < F.size("texts"), F.get("texts", then)).otherwise(beyond(then)["x"]["l"]).alias("line_next"),
            x["stage"].alias("stage"), x["kind"].alias("kind"),
        )

    return _stored(met.select(key, F.inline(F.transform("done", line))), "read"), coded.select(key)


def stage_positions(segments: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value") -> DataFrame:
    """Where each stage of each document was read: first and last line, and how many."""
    plan = plan or default_plan()
    read = read_stages(segments, plan, key, value).where(F.col("kind") == READ)
    found = read.groupBy(key, "stage").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n_lines")
    )
    names = F.array(*[F.lit(s.name) for s in plan.stages])
    return found.withColumn("task", F.get(names, F.col("stage")))


def _lines_of(stage_no: int) -> Column:
    return F.filter("kept", lambda x: x["s"] == stage_no)


def _contexts(keys: DataFrame, read: DataFrame, plan: ReportPlan, key: str) -> DataFrame:
    """One row per document in the form of unsplit ones: the lines read before the table, by stage."""
    lines = read.where(F.col("kind") == READ)
    before = lines.where(F.col("stage") != (plan.sticky if plan.sticky is not None else -1))
    # the list of a document becomes one text of the report, so its lines fit a row
    entry = F.struct(F.col("line_no").alias("n"), F.col("stage").alias("s"), F.col("line").alias("l"))
    docs = keys.distinct()
    docs = _joined(docs, before.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("kept")), [key])
    if plan.sticky is None:
        docs = docs.withColumns({"first_row": F.lit(None).cast("long"), "reached": F.lit(True)})
    else:
        own = read.where(F.col("stage") == plan.sticky).groupBy(key).agg(
            F.min(F.when(F.col("kind") == READ, F.col("line_no"))).alias("first_row"),
            F.bool_or(F.col("kind") == ENTERED).alias("reached"),
        )
        docs = _joined(docs, own, [key]).withColumn("reached", F.coalesce("reached", F.lit(False)) | F.lit(plan.sticky == 0))
    docs = docs.withColumn("kept", F.coalesce("kept", F.array().cast(docs.schema["kept"].dataType)))
    at = [F.array_position(F.transform("kept", lambda x: x["s"]), i).cast("int") - 1 for i in range(len(plan.stages))]
    docs = stage(docs, seg=F.struct(F.array(*at).alias("read")))
    columns = {}
    for i in _singles(plan):
        line = line_at(read_position(i))
        columns[_head_name(i)] = F.when(line.isNotNull(), plan.stages[i].grammar.parse(line))
    for i in _loops(plan):
        columns[_list_name(i)] = _parsed_lines(_lines_of(i), plan.stages[i].grammar)
    docs = stage(docs, **columns)
    docs = stage(docs, usable=has_required(plan) & ~_bad_context(plan))
    first = F.coalesce(*[F.get(_list_name(i), F.lit(0))["n"] for i in _loops(plan)], "first_row")
    return docs.withColumn("stopped_at", F.when(~F.col("usable"), first))


def diagnostics(segments: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value") -> DataFrame:
    """``(key, line_no, task, kind, level, line, line_next)`` as of the whole documents."""
    plan = plan or default_plan()
    read, keys = _read_stages(segments, plan, key, value)
    ctx = _stored(_contexts(keys, read, plan, key), "contexts")
    none = F.lit(None)
    said = _joined(read.where(~F.col("kind").isin(READ, ENTERED)), ctx.select(key, "stopped_at"), [key])
    stop, in_table = F.col("stopped_at"), F.col("kind").startswith(TABLE)
    said = said.where(stop.isNull() | (F.col("line_no") < stop) | ((F.col("line_no") == stop) & ~in_table))
    damaged = events_of.BAD_PARAMETERS
    if plan.sticky is not None and not plan.detail.grammar.loose:
        damaged = events_of.MASKED
    kind = F.when(in_table, F.substring("kind", len(TABLE) + 1, 100)).otherwise(F.col("kind"))
    kind = F.when(kind == DAMAGED, damaged).otherwise(kind)
    parts = [said.select(key, "line_no", "stage", kind.alias("kind"), "line", "line_next")]
    lists = F.concat(events_of._none(), *[events_of._list_events(plan, i) for i in _loops(plan)])
    ends = [F.when(F.col("usable"), lists).otherwise(events_of._none())]
    if plan.sticky is not None:
        nothing = events_of._event(none, F.lit(plan.sticky), F.lit(events_of.NOTHING), none, none)
        ends.append(F.when(~F.col("reached") & stop.isNull(), F.array(nothing)).otherwise(events_of._none()))
    rest = events_of._event(stop, none, F.lit(events_of.REST_SKIPPED), none, none)
    ends.append(F.when(stop.isNotNull(), F.array(rest)).otherwise(events_of._none()))
    parts.append(ctx.select(key, F.inline(F.concat(*ends))))
    events = parts[0].unionByName(parts[1])
    names = F.array(*[F.lit(s.name) for s in plan.stages])
    return events.select(
        key, "line_no", F.get(names, F.col("stage")).alias("task"), "kind", events_of.level_of(F.col("kind")).alias("level"), "line", "line_next"
    )


def production_wide(segments: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value") -> DataFrame:
    """The report output of split documents: one text row per detail line, columns in header order."""
    plan = plan or default_plan()
    if plan.sticky is None:
        raise ValueError("the plan has no final repeating stage, so it gives no rows")
    read, keys = _read_stages(segments, plan, key, value)
    context = {f"ctx_{n}": c for n, c in context_values(plan).items()}
    ctx = stage(_contexts(keys, read, plan, key).where("usable"), **context, header=_header(plan))
    ctx = _stored(ctx.select(key, *context, "header"), "contexts")
    rows = read.where((F.col("kind") == READ) & (F.col("stage") == plan.sticky)).select(key, "line_no", "line")
    grammar = plan.detail.grammar
    rows = grammar.with_parsed(_joined(rows, ctx, [key], "inner"), "line", "header", "parsed")
    rows = rows.withColumn("parsed", grammar.cleaned(F.col("parsed"), F.col("line")))
    known = {n: F.col(f"ctx_{n}") for n in context_values(plan)}
    known.update(grammar.texts(F.col("parsed")))
    known[FILE_FIELD] = F.col(key).cast("string")
    return rows.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in plan.columns])
