"""Segmented documents to tables: context, wells, and the wide, typed and long views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import cells
from reportlake.operators.segment import (
    line_at,
    read_position,
    repeated_lines,
    sticky_lines,
    with_segments,
)
from reportlake.operators.staging import per_plan, stage
from reportlake.plans.grammar import FILE_FIELD, MARKER_FIELD, Grammar, ReportPlan, default_plan

SEPARATOR = "; "
NULL_TEXT = "None"


def text_or_none(value: Column) -> Column:
    """Null written as the text it gets in the report output."""
    return F.coalesce(value, F.lit(NULL_TEXT))


def _loops(plan: ReportPlan) -> list[int]:
    return [i for i, s in enumerate(plan.stages) if s.repeats and i != plan.sticky]


def _singles(plan: ReportPlan) -> list[int]:
    return [i for i, s in enumerate(plan.stages) if not s.repeats]


def _list_name(stage: int) -> str:
    return f"list_{stage}"


def _head_name(stage: int) -> str:
    return f"head_{stage}"


def _parsed_lines(lines: Column, grammar: Grammar) -> Column:
    return F.transform(
        lines,
        lambda x: F.struct(x["n"].alias("n"), x["l"].alias("l"), grammar.parse_entry(x["l"]).alias("p")),
    )


def _listed_texts(stage: int, grammar: Grammar, name: str, parsed: bool) -> Column:
    """The values of a repeating stage as one text."""
    lines = F.col(_list_name(stage))
    if not parsed:
        return grammar.joined(lines["l"], name, SEPARATOR, NULL_TEXT)
    return F.array_join(F.transform(lines, lambda x: text_or_none(grammar.values(x["p"])[name])), SEPARATOR)


@per_plan
def _head_columns(plan: ReportPlan) -> dict[str, Column]:
    columns = {}
    for i in _singles(plan):
        if set(plan.stages[i].grammar.fields) <= {MARKER_FIELD}:
            continue
        line = line_at(read_position(i))
        parsed = plan.stages[i].grammar.parse(line)
        columns[_head_name(i)] = F.when(line.isNotNull(), parsed)
    return columns


@per_plan
def _list_columns(plan: ReportPlan, parsed: bool) -> dict[str, Column]:
    columns = {}
    for i in _loops(plan):
        lines = repeated_lines(plan, i)
        columns[_list_name(i)] = _parsed_lines(lines, plan.stages[i].grammar) if parsed else lines
    return columns


def with_context(docs: DataFrame, plan: ReportPlan, value: str = "value", parsed: bool = True) -> DataFrame:
    """Segmented documents with the parsed line of every single-line stage and the
    parsed lines of every repeating stage before the detail table.

    Without ``parsed`` the lists hold their lines only, and the single lines are parsed in a plain
    projection: Spark leaves out those that are not read, so no lambda may read them.
    """
    docs = with_segments(docs, plan, value)
    if parsed:
        return stage(docs, **_head_columns(plan), **_list_columns(plan, True))
    lists = _list_columns(plan, False)
    return (stage(docs, **lists) if lists else docs).withColumns(_head_columns(plan))


@per_plan
def context_values(plan: ReportPlan, parsed: bool = True) -> dict[str, Column]:
    """Document-level fields as text, merged in stage order; ``parsed`` as in ``with_context``.

    A single-line stage overwrites what earlier stages gave.  A repeating stage
    joins its values with ``; `` in line order, after what is already there.
    A line with any null field writes its nulls as text.
    """
    out: dict[str, Column] = {}
    for i, stage in enumerate(plan.stages):
        if i == plan.sticky:
            break
        for name in stage.grammar.fields:
            if name == MARKER_FIELD:
                continue
            before = out.get(name, F.lit(None).cast("string"))
            if stage.repeats:
                items = _listed_texts(i, stage.grammar, name, parsed)
                whole = F.concat(F.coalesce(F.concat(before, F.lit(SEPARATOR)), F.lit("")), items)
                out[name] = F.when(F.size(_list_name(i)) > 0, whole).otherwise(before)
            else:
                head = F.col(_head_name(i))
                out[name] = F.when(head.isNotNull(), stage.grammar.values(head)[name]).otherwise(before)
    return out


@per_plan
def has_required(plan: ReportPlan) -> Column:
    """The required field was read by a single-line stage before the first repeating line."""
    ok = F.lit(True)
    readers = [i for i in _singles(plan) if plan.required in plan.stages[i].grammar.fields]
    order = [*_loops(plan)] + ([] if plan.sticky is None else [plan.sticky])
    for i in reversed(sorted(order)):
        known = F.lit(False)
        for j in (r for r in readers if r < i):
            known = known | (read_position(j) >= 0)
        reached = F.lit(True) if i == plan.sticky else F.size(_list_name(i)) > 0
        ok = F.when(reached, known).otherwise(ok)
    return ok


@per_plan
def _bad_context(plan: ReportPlan) -> Column:
    """A repeating stage cannot append to a null the context already holds."""
    bad = F.lit(False)
    for i in _loops(plan):
        for name in plan.stages[i].grammar.fields:
            for j in (s for s in _singles(plan) if s < i):
                if name in plan.stages[j].grammar.fields:
                    head = F.col(_head_name(j))
                    bad = bad | (
                        (F.size(_list_name(i)) > 0)
                        & head.isNotNull()
                        & plan.stages[j].grammar.values(head)[name].isNull()
                    )
    return bad


def document_context(
    docs: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value"
) -> DataFrame:
    """One row per document: its header fields and joined lists, null when not read."""
    plan = plan or default_plan()
    ctx = with_context(docs.select(key, value), plan, value, parsed=False)
    values = context_values(plan, False)
    out = stage(ctx, **values, has_required=has_required(plan))
    return out.select(key, *values, "has_required")


def listed_items(
    docs: DataFrame, stage: str, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value"
) -> DataFrame:
    """One row per line of a repeating stage before the detail table."""
    plan = plan or default_plan()
    i = plan.index_of(stage)
    grammar = plan.stages[i].grammar
    ctx = with_context(docs.select(key, value), plan, value)
    items = F.when(has_required(plan), F.col(_list_name(i)))
    rows = ctx.select(key, F.explode(items).alias("x"))
    return rows.select(
        key, F.col("x.n").alias("line_no"), *[c.alias(n) for n, c in grammar.values(F.col("x.p")).items()]
    )


def detail_lines(
    docs: DataFrame,
    plan: ReportPlan,
    key: str = "doc_id",
    value: str = "value",
    keep: tuple[str, ...] = (),
    cleaned: bool = False,
) -> DataFrame:
    """One row per detail line with the parsed row and the document's context fields.

    With ``cleaned`` the parsed row holds its output texts.  The context rides along with the line through ``explode``; no join, no shuffle.
    """
    if plan.sticky is None:
        raise ValueError("the plan has no final repeating stage, so it gives no rows")
    ctx = with_context(docs.select(key, value, *keep), plan, value, parsed=False)
    context = {f"ctx_{n}": c for n, c in context_values(plan, False).items()}
    # a plain projection: what a query does not read is not worked out; the generator is the border, and keeps
    # the compiled code of documents and of lines apart, which together the JVM would find too long to compile
    ctx = stage(ctx.withColumns({**context, "header": _header(plan)}), offered=_offered(plan))
    rows = ctx.select(
        key, *keep, *context, "header", F.explode_outer(F.col("offered")).alias("x")
    )
    rows = rows.where(F.col("x").isNotNull()).select(
        key, *keep, *context, "header", F.col("x.n").alias("line_no"), F.col("x.l").alias("line")
    )
    grammar = plan.detail.grammar
    rows = grammar.with_parsed(rows, "line", "header", "parsed").drop("header")
    if cleaned:
        rows = rows.withColumn("parsed", grammar.cleaned(F.col("parsed"), F.col("line")))
    return rows


@per_plan
def _header(plan: ReportPlan) -> Column:
    """What the detail grammar needs of the table's header line."""
    at = plan.index_of(plan.header_stage) if plan.header_stage else None
    line = F.lit(None).cast("string")
    if at is not None and at < plan.sticky:
        line = line_at(read_position(at))
    return plan.detail.grammar.prepare(line)


@per_plan
def _offered(plan: ReportPlan) -> Column:
    usable = has_required(plan) & ~_bad_context(plan)
    return F.when(usable, sticky_lines(plan))


@per_plan
def _row_values(plan: ReportPlan) -> dict[str, Column]:
    return plan.detail.grammar.values(F.col("parsed"))


@per_plan
def _row_texts(plan: ReportPlan) -> dict[str, Column]:
    return plan.detail.grammar.texts(F.col("parsed"))


def production_wide(
    docs: DataFrame,
    plan: ReportPlan | None = None,
    key: str = "doc_id",
    value: str = "value",
    file: str | None = None,
    position: bool = False,
) -> DataFrame:
    """The report output: one text row per detail line, columns in header order.

    Fields never read are null here and empty in the written file.  ``position``
    adds the document key and line number, by which the output can be ordered.
    """
    plan = plan or default_plan()
    keep = (file,) if file and file != key else ()
    rows = detail_lines(docs, plan, key, value, keep, cleaned=True)
    known = {n[len("ctx_"):]: F.col(n) for n in rows.columns if n.startswith("ctx_")}
    known.update(_row_texts(plan))
    known[FILE_FIELD] = F.col(file or key).cast("string")
    blank = F.lit(None).cast("string")
    columns = [known.get(c, blank).alias(c) for c in plan.columns]
    place = [F.col(key), F.col("line_no")] if position else []
    return rows.select(*place, *columns)


def production_typed(
    docs: DataFrame,
    plan: ReportPlan | None = None,
    key: str = "doc_id",
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed rows: year or total flag, numeric cells, and the names of masked cells."""
    plan = plan or default_plan()
    rows = detail_lines(docs, plan, key, value, keep)
    values = _row_values(plan)
    masked = plan.detail.grammar.masked(F.col("parsed"))
    context = [F.col(c).alias(c[len("ctx_"):].lower()) for c in rows.columns if c.startswith("ctx_")]
    year = values[cells.YEAR]
    return rows.select(
        key,
        *keep,
        "line_no",
        *context,
        F.when(year != cells.TOTALS, year.try_cast("int")).alias("year"),
        (year == cells.TOTALS).alias("is_total"),
        *[values[c].try_cast("double").alias(c.lower()) for c in cells.CELLS],
        masked.alias("masked"),
    )


def production_long(
    docs: DataFrame,
    plan: ReportPlan | None = None,
    key: str = "doc_id",
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document, year and month; the input's total rows are left out."""
    rows = production_typed(docs, plan, key, value, keep).where(~F.col("is_total"))
    others = [c for c in rows.columns if c not in {m.lower() for m in cells.CELLS} | {"masked", "is_total"}]
    months = F.array(*[F.col(m.lower()) for m in cells.MONTHS])
    exploded = rows.select(*others, "masked", F.posexplode(months).alias("pos", "volume"))
    names = F.array(*[F.lit(m) for m in cells.MONTHS])
    return exploded.select(
        *others,
        (F.col("pos") + 1).alias("month"),
        "volume",
        F.array_contains("masked", F.get(names, F.col("pos"))).alias("masked"),
    )
