"""Try every grammar on every line: nullable parsed columns for exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions import cells
from reportlake.operators.extract import _list_name, _loops, has_required, with_context
from reportlake.operators.segment import read_position, sticky_lines
from reportlake.plans.grammar import ReportPlan, default_plan


def classify(lines: DataFrame, plan: ReportPlan | None = None, line: str = "line") -> DataFrame:
    """``lines`` with one nullable struct of fields per grammar of the plan."""
    plan = plan or default_plan()
    text = F.col(line)
    grammars = {s.grammar.name: s.grammar for s in plan.stages}
    parsed = {f"_{n}": F.when(g.matches(text), g.parse(text)) for n, g in grammars.items()}
    columns = []
    for name, grammar in grammars.items():
        found = F.col(f"_{name}")
        fields = F.struct(*[c.alias(n) for n, c in grammar.values(found).items()])
        columns.append(F.when(found.isNotNull(), fields).alias(name))
    # a plain projection, which Spark compiles; a generator would work the fields out expression by expression
    return lines.withColumns(parsed).select(*lines.columns, *columns)


def stage_positions(
    docs: DataFrame, plan: ReportPlan | None = None, key: str = "doc_id", value: str = "value"
) -> DataFrame:
    """Where each stage of each document was read: first and last line, and how many."""
    plan = plan or default_plan()
    ctx = with_context(docs.select(key, value), plan, value, parsed=False)
    kept = F.col("kept")
    entries = []
    for i, step in enumerate(plan.stages):
        if i == plan.sticky:
            numbers = sticky_lines(plan)["n"]
        elif i in _loops(plan):
            numbers = F.col(_list_name(i))["n"]
        else:
            at = read_position(i)
            numbers = F.array_compact(F.array(F.when(at >= 0, F.get(kept, at)["n"])))
        place = cells.let(
            numbers,
            lambda ns: F.struct(F.array_min(ns).alias("first"), F.array_max(ns).alias("last"), F.size(ns).alias("n")),
        )
        entries.append(F.struct(F.lit(i).alias("stage"), F.lit(step.name).alias("task"), place.alias("place")))
    rows = ctx.select(key, has_required(plan).alias("has_required"), F.inline(F.array(*entries)))
    spans = {"first_line": "place.first", "last_line": "place.last", "n_lines": "place.n"}
    return rows.select(key, "has_required", "stage", "task", *[F.col(c).alias(n) for n, c in spans.items()]).where(F.col("n_lines") > 0)
