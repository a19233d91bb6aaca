"""Every skipped, refused or damaged line as a row, and the outcome of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.operators.extract import _bad_context, _list_name, _loops, has_required, with_context
from reportlake.operators.segment import (
    NEVER,
    NO_MATCH,
    SKIPPED,
    is_detail,
    read_position,
    sticky_lines,
    table_positions,
)
from reportlake.operators.staging import per_plan, stage
from reportlake.plans.grammar import Grammar, ReportPlan, default_plan

BAD_PARAMETERS = "bad_parameters"
NOTHING = "nothing_before_table"
REST_SKIPPED = "rest_skipped"
MASKED = "masked_cell"
UNDECODABLE = "undecodable"

#: Column of the reader with the first line that cannot be decoded.
BAD_LINE = "bad_line"

# Message levels, lowest first.
LEVELS = ["NOTSET", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
_INFO_KINDS = [MASKED]

_EVENT = "struct<line_no:int,stage:int,kind:string,line:string,line_next:string>"


def level_of(kind: Column) -> Column:
    return F.when(kind.isin(_INFO_KINDS), F.lit("INFO")).otherwise(F.lit("WARNING"))


def at_least(events: DataFrame, level: str) -> DataFrame:
    """Events of the given severity or above."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    wanted = [x for x in LEVELS if LEVELS.index(x) >= LEVELS.index(level)]
    return events.where(F.col("level").isin(wanted))


def _event(line_no: Column, stage_no: Column, kind: Column, line: Column, ahead: Column) -> Column:
    return F.struct(
        line_no.cast("int").alias("line_no"),
        stage_no.cast("int").alias("stage"),
        kind.cast("string").alias("kind"),
        line.cast("string").alias("line"),
        ahead.cast("string").alias("line_next"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{_EVENT}>")


def _fold_events(stop: Column) -> Column:
    kept = F.col("kept")
    events = F.transform(
        F.col("seg.notes"),
        lambda n: _event(
            F.get(kept, n["at"])["n"],
            n["stage"],
            n["kind"],
            F.get(kept, n["at"])["l"],
            F.get(kept, n["at"] + 1)["l"],
        ),
    )
    return F.filter(events, lambda e: stop.isNull() | (e["line_no"] <= stop))


def _null_field(grammar: Grammar, parsed: Column) -> Column:
    bad = F.lit(False)
    for value in grammar.values(parsed).values():
        bad = bad | value.isNull()
    return bad


def _list_events(plan: ReportPlan, i: int) -> Column:
    grammar = plan.stages[i].grammar
    damaged = F.filter(F.col(_list_name(i)), lambda x: _null_field(grammar, x["p"]))
    return F.transform(
        damaged,
        lambda x: _event(x["n"], F.lit(i), F.lit(BAD_PARAMETERS), x["l"], F.lit(None)),
    )


@per_plan
def _sticky_events(plan: ReportPlan) -> Column:
    """Detail lines that did not match, and matching ones with masked cells or nulls."""
    kept, quiet, grammar = F.col("kept"), F.col("seg.quiet"), plan.detail.grammar

    def event(i: Column) -> Column:
        here, ahead = F.get(kept, i), F.get(kept, i + 1)
        missed = ~is_detail(plan, here)
        kind = F.when(missed & is_detail(plan, ahead, whole=True), F.lit(SKIPPED)).when(
            missed, F.lit(NO_MATCH)
        )
        damaged = F.lit(MASKED if not grammar.loose else BAD_PARAMETERS)
        return _event(
            here["n"], F.lit(plan.sticky), F.coalesce(kind, damaged), here["l"], ahead["l"]
        )

    def worth(i: Column) -> Column:
        here = F.get(kept, i)
        if not grammar.wide:
            return ~is_detail(plan, here, whole=True)
        return ~is_detail(plan, here) | here["l"].contains("#")

    return F.transform(
        F.filter(
            table_positions(plan),
            lambda i: worth(i) & ((i >= quiet) | is_detail(plan, F.get(kept, i))),
        ),
        event,
    )


def _first_repeated(plan: ReportPlan) -> Column:
    """Number of the first line any repeating stage read."""
    found = [F.get(F.col(_list_name(i)), F.lit(0))["n"] for i in _loops(plan)]
    if plan.sticky is not None:
        found.append(F.get(sticky_lines(plan), F.lit(0))["n"])
    return F.coalesce(*found) if found else F.lit(None).cast("int")


def _staged(docs: DataFrame, plan: ReportPlan, key: str, value: str) -> DataFrame:
    more = [BAD_LINE] if BAD_LINE in docs.columns else []
    ctx = with_context(docs.select(key, value, *more), plan, value)
    usable = has_required(plan) & ~_bad_context(plan)
    return stage(
        ctx, usable=usable, stopped_at=F.when(~usable, _first_repeated(plan))
    )


def _reached(plan: ReportPlan) -> Column:
    low = F.get(F.col("seg.low"), F.lit(plan.sticky))
    return (low < NEVER) | (read_position(plan.sticky) >= 0)


def diagnostics(
    docs: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value"
) -> DataFrame:
    """``(key, line_no, task, kind, level, line, line_next)``; computed without a shuffle.

    Where the reader noted a line that cannot be decoded, at which reading ended, it is an event too.
    """
    plan = plan or default_plan()
    ctx = _staged(docs, plan, key, value)
    stop = F.col("stopped_at")
    lists = F.concat(_none(), *[_list_events(plan, i) for i in _loops(plan)])
    parts = [_fold_events(stop), F.when(F.col("usable"), lists).otherwise(_none())]
    if plan.sticky is not None:
        parts.append(
            F.when(stop.isNull(), _sticky_events(plan)).otherwise(
                F.filter(_sticky_events(plan), lambda e: e["line_no"] < stop)
            )
        )
        nothing = _event(F.lit(None), F.lit(plan.sticky), F.lit(NOTHING), F.lit(None), F.lit(None))
        empty = ~_reached(plan) & stop.isNull()
        parts.append(F.when(empty, F.array(nothing)).otherwise(_none()))
    rest = _event(stop, F.lit(None), F.lit(REST_SKIPPED), F.lit(None), F.lit(None))
    parts.append(F.when(stop.isNotNull(), F.array(rest)).otherwise(_none()))
    if BAD_LINE in docs.columns:
        bad = _event(F.col(BAD_LINE), F.lit(None), F.lit(UNDECODABLE), F.lit(None), F.lit(None))
        parts.append(F.when(F.col(BAD_LINE).isNotNull() & stop.isNull(), F.array(bad)).otherwise(_none()))
    events = ctx.select(key, F.inline(F.concat(*parts)))

    names = F.array(*[F.lit(s.name) for s in plan.stages])
    return events.select(
        key,
        "line_no",
        F.get(names, F.col("stage")).alias("task"),
        "kind",
        level_of(F.col("kind")).alias("level"),
        "line",
        "line_next",
    )


def document_outcomes(
    docs: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value"
) -> DataFrame:
    """One row per document: how many rows it gave and how its reading ended.

    Rows are counted inside the document's own row, so no shuffle is needed even
    to report the documents that gave nothing.
    """
    plan = plan or default_plan()
    ctx = _staged(docs, plan, key, value)
    read = sticky_lines(plan)
    rows = F.when(F.col("usable"), F.size(read)).otherwise(F.lit(0))
    ctx = stage(ctx, n_rows=rows.cast("bigint"))
    outcome = (
        F.when(F.col("n_rows") > 0, F.lit("rows"))
        .when(F.col("stopped_at").isNotNull(), F.lit(REST_SKIPPED))
        .otherwise(F.lit(NOTHING))
    )
    return ctx.select(
        key, F.size("kept").cast("bigint").alias("n_lines"), "n_rows", outcome.alias("outcome")
    )
