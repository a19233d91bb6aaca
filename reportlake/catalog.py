"""Registered queries over the given tables, each with its SQL equivalent.

Report queries parse documents that Spark renders from the star schema; the SQL
computes the same answer from the base tables, never looking at a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions import pages as page_fn
from reportlake.functions import text as text_fn
from reportlake.functions.cells import MONTHS
from reportlake.operators import landing, names, splits, worklist
from reportlake.operators.classify import classify, stage_positions
from reportlake.operators.custom import per_document
from reportlake.operators.diagnostics import at_least, diagnostics, document_outcomes
from reportlake.operators.extract import (
    document_context,
    listed_items,
    production_long,
    production_typed,
    production_wide,
)
from reportlake.operators.lines import cut_at_bad_bytes, explode_lines
from reportlake.operators.many import classify_many
from reportlake.operators.numbering import enumerated, numbered
from reportlake.plans.grammar import GRAMMARS, TASKS, Grammar, build_plan, default_plan, settings_from_config
from reportlake.session import shared_folder
from reportlake.sources import readers, sinks
from reportlake.sources.rendered import render_reports, render_result_pages
from reportlake.streaming import state as keyed
from reportlake.streaming.ingest import ingest, ingest_new, stream_documents, stream_reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- SQL building blocks -----------------------------------------------------

_LINES = """
raw AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
split AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no,
                 trim(unnest(a), chr(13) || chr(10)) AS line FROM raw),
lines AS (SELECT * FROM split WHERE length(line) > 0)
"""

_M = [f"m{i}" for i in range(1, 13)]
_MONTHLY = ",\n".join(f"CAST(sum(CASE WHEN mo = {i} THEN q ELSE 0 END) AS BIGINT) AS m{i}" for i in range(1, 13))
# One document per supplier and brand; the flags are the variants of the renderer, j counts junk lines,
# and the lines are numbered: buyer, unit and head, then n list lines, the end mark, and the table.
_NUMBER_SQL = r"l_suppkey * 100 + CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT)"
_REPORTS = rf"""
shipped AS (SELECT {_NUMBER_SQL} AS k, l_partkey AS p,
                   year(l_shipdate) AS y, month(l_shipdate) AS mo, l_quantity AS q
            FROM lineitem JOIN part ON l_partkey = p_partkey),
place AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier
          JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
monthly AS (SELECT k, y, {_MONTHLY} FROM shipped GROUP BY 1, 2),
rows_ AS (SELECT * FROM (
          SELECT k, CAST(y AS VARCHAR) AS yr, {", ".join(_M)}, {" + ".join(_M)} AS tot FROM monthly
          UNION ALL
          SELECT k, 'Totals', {", ".join(f"CAST(sum({m}) AS BIGINT)" for m in _M)},
                 CAST(sum({" + ".join(_M)}) AS BIGINT) FROM monthly GROUP BY k) WHERE k % 23 <> 7),
years AS (SELECT k, count(*) AS ny FROM monthly GROUP BY k),
parts AS (SELECT DISTINCT k, p FROM shipped),
wells AS (SELECT k, string_agg(lpad(CAST(p AS VARCHAR), 7, '0'), '; ' ORDER BY p) AS permit,
                 string_agg(p_name || ' #' || p, '; ' ORDER BY p) AS well, count(*) AS nw
          FROM parts JOIN part ON p_partkey = p GROUP BY k),
flags AS (SELECT k, k % 11 <> 10 AS known, k % 5 = 2 AS junk, k % 19 = 3 AND k % 5 <> 2 AS lost,
                 k % 23 <> 7 AS tab FROM years),
docs AS (SELECT k, place.*, ny, nw, known, junk, lost, tab,
                permit || CASE WHEN k % 7 = 4 THEN '; None' ELSE '' END AS permit,
                well || CASE WHEN k % 7 = 4 THEN '; Unnumbered well' ELSE '' END AS well,
                CASE WHEN NOT lost THEN s_name END AS buyer_name, CASE WHEN NOT lost THEN CAST(k AS VARCHAR) END AS lease,
                CASE WHEN NOT lost THEN CASE WHEN k % 2 = 0 THEN 'Gas' ELSE 'Oil' END END AS type_,
                k % 4 = 1 AND ny > 3 AND tab AS breaks, k % 6 = 3 AS masked, k % 7 = 4 AS extra, k % 13 = 5 AS gap, k % 17 = 6 AS mixed,
                CAST(junk AS BIGINT) + 3 * CAST(lost AS BIGINT) AS j, nw + CAST(k % 7 = 4 AS BIGINT) AS n,
                CAST(known AS BIGINT) + CAST(junk AS BIGINT) + 3 * CAST(lost AS BIGINT) + 1 AS buyer,
                buyer + CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END AS unit, unit + 1 AS head,
                CAST(known AS BIGINT) + j + 3 + n + 1 + CASE WHEN tab THEN ny + 2 + CAST(breaks AS BIGINT) ELSE 0 END + 1 AS n_lines
         FROM flags JOIN place ON s_suppkey = k // 100 JOIN years USING (k) JOIN wells USING (k))
"""


def _cell(i: int) -> str:
    text = f"CAST(m{i} AS VARCHAR)"
    if i == 3:
        return f"CASE WHEN gap THEN '' ELSE {text} END"
    if i == 6:
        return f"CASE WHEN masked THEN '' ELSE {text} END"
    if i == 7:
        return f"CASE WHEN mixed THEN '0' ELSE '' END || {text}"
    return text


_HEAD_SQL = (
    "buyer_name AS Buyer, 'Unassigned' AS Pool, permit AS Permit, well AS Well, r_name AS Quad, "
    "n_name AS County, type_ AS Type, lease AS Lease, yr AS Year"
)
_CELLS_SQL = f"""{", ".join(f"{_cell(i)} AS {m}" for i, m in enumerate(MONTHS, 1))},
       CAST(tot AS VARCHAR) AS Totals, CAST(k AS VARCHAR) AS File"""
_WIDE_SQL = f"""WITH {_REPORTS}
SELECT {_HEAD_SQL}, {_CELLS_SQL} FROM docs JOIN rows_ USING (k) WHERE known"""

_BY_SUPPLIER = _REPORTS.replace(_NUMBER_SQL, "l_suppkey").replace("k // 100", "k")
_WIDE_BY_SUPPLIER = f"""WITH {_BY_SUPPLIER}
SELECT {_HEAD_SQL}, {_CELLS_SQL} FROM docs JOIN rows_ USING (k) WHERE known"""

_PACKED_SQL = f"""WITH {_REPORTS},
kept AS (SELECT *, list_concat(list_filter([{", ".join(
    f"CASE WHEN gap THEN NULL ELSE CAST(m{i} AS VARCHAR) END" if i == 3
    else f"CASE WHEN masked THEN NULL ELSE CAST(m{i} AS VARCHAR) END" if i == 6
    else f"CAST(m{i} AS VARCHAR)" for i in range(1, 13))}], lambda x: x IS NOT NULL), ['', '']) AS c
  FROM docs JOIN rows_ USING (k) WHERE known AND NOT mixed)
SELECT {_HEAD_SQL}, {", ".join(f"c[{i}] AS {m}" for i, m in enumerate(MONTHS, 1))},
       CAST(tot AS VARCHAR) AS Totals, CAST(k AS VARCHAR) AS File FROM kept"""

_LONG_SQL = f"""long_ AS (
SELECT docs.*, CAST(yr AS INTEGER) AS year, month,
       masked AND month = 6 OR mixed AND month = 7 AS is_masked,
       CASE WHEN (masked AND month = 6) OR (gap AND month = 3) THEN NULL ELSE CAST(v AS DOUBLE) END AS volume
FROM docs JOIN (SELECT k, yr, unnest(range(1, 13)) AS month, unnest([{", ".join(_M)}]) AS v
                FROM rows_ WHERE yr <> 'Totals') USING (k) WHERE known)"""


def _events_sql(packed: bool) -> str:
    """Every event of a parse, from the transition table. Of a document without its county line the
    list has to have four lines at least, as all have from sf0.01 on."""
    task = {n: f"'{n}'" for n in TASKS if n}
    place, head, well, row = (task[n] for n in ("County_Quad_Pool", "Permit_Well_header", "Permit_Well", "Product_by_month"))
    buyer = task["Buyer_Lease_Type_Active"]
    parts = [
        (2, buyer, "skipped_bad_line", "known AND junk"),
        (2, buyer, "no_match", "known AND lost"),
        (3, buyer, "no_match", "known AND lost"),
        ("buyer", head, "no_match", "known AND lost"),
        ("unit", head, "skipped_bad_line", "known AND lost"),
        ("head + n", well, "bad_parameters", "known AND extra"),
        ("NULL", row, "nothing_before_table", "known AND NOT tab"),
        (1, place, "no_match", "NOT known"),
        ("CASE j WHEN 0 THEN unit ELSE 2 END", place, "no_match", "NOT known"),
        (3, buyer, "skipped_bad_line", "NOT known AND lost"),
        ("head", buyer, "no_match", "NOT known AND j = 0"),
        ("head + 1", buyer, "no_match", "NOT known AND j = 0"),
        ("head + 3", head, "no_match", "NOT known AND j = 0"),
        ("head + 4", head, "no_match", "NOT known AND j = 0"),
        ("head + CASE j WHEN 0 THEN 4 ELSE 1 END", "NULL", "rest_skipped", "NOT known"),
    ]
    selects = [f"SELECT k, {line} AS line_no, {name} AS task, '{kind}' AS kind FROM docs WHERE {when}" for line, name, kind, when in parts]
    kind = "CASE WHEN mixed THEN 'no_match' ELSE 'masked_cell' END" if packed else "'masked_cell'"
    selects.append(
        f"""SELECT k, head + n + 3 + i + CASE WHEN breaks AND i >= 3 THEN 1 ELSE 0 END, {row}, {kind}
        FROM (SELECT *, unnest(range(0, ny + 1)) AS i FROM docs WHERE known AND tab AND (masked OR mixed))"""
    )
    return f"""events_ AS (SELECT k AS doc_id, CAST(coalesce(line_no, 0) AS BIGINT) AS line_no, task, kind,
        CASE kind WHEN 'masked_cell' THEN 'INFO' ELSE 'WARNING' END AS level FROM ({" UNION ALL ".join(selects)}))"""


# --- Lines -------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(_documents(spark, sf_dir)).select("doc_id", _big("line_no"), "line")


@query(
    f"""WITH {_LINES},
    ahead AS (SELECT doc_id, line_no, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS line_next FROM lines)
    SELECT doc_id, line_no, line_next,
           line_next IS NOT NULL AND NOT starts_with(line_next, chr(12)) AS is_current FROM ahead"""
)
def lines_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(_documents(spark, sf_dir))
    return lines.select("doc_id", _big("line_no"), "line_next", "is_current")


@query(ORACLES["lines_lookahead"])
def split_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of documents that come in rows of three lines each."""
    lines = splits.explode_segments(splits.cut_documents(_documents(spark, sf_dir), 3))
    return lines.select("doc_id", _big("line_no"), "line_next", "is_current")


@query(
    f"""WITH {_REPORTS}
    SELECT k AS doc_id, n_lines, n_lines - 1 - CAST(breaks AS BIGINT) AS n_current, CAST(breaks AS BIGINT) AS n_breaks
    FROM docs"""
)
def page_footer_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(render_reports(spark, sf_dir))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("is_current").alias("n_current"),
        F.max("page_no").cast("bigint").alias("n_breaks"),
    )


@query(
    f"""WITH {_REPORTS},
    counts AS (SELECT CAST(known AS BIGINT) AS county, j, n, tab, ny, CAST(breaks AS BIGINT) AS b FROM docs)
    SELECT CAST(sum(county) AS BIGINT) AS n_county, count(*) AS n_buyer, count(*) AS n_permit_header,
           CAST(sum(county + j + 3 + n + 1 + 2 * b) AS BIGINT) AS n_permit, count(*) AS n_permit_end,
           count(*) FILTER (tab) AS n_month_header, CAST(sum(ny + 1) FILTER (tab) AS BIGINT) AS n_month,
           CAST(sum(n) AS BIGINT) AS n_listed
    FROM counts"""
)
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grammar tried on every line, whatever its stage."""
    docs = render_reports(spark, sf_dir)
    lines = classify(explode_lines(docs))

    def n(name: str) -> Column:
        return F.count(name)

    well = F.col("Permit_Well.Well")
    listed = well.rlike(r" #\d+$") | (well == "Unnumbered well")
    return lines.agg(
        n("County_Quad_Pool").alias("n_county"),
        n("Buyer_Lease_Type_Active").alias("n_buyer"),
        n("Permit_Well_header").alias("n_permit_header"),
        n("Permit_Well").alias("n_permit"),
        n("Permit_Well_end").alias("n_permit_end"),
        n("Product_by_month_header").alias("n_month_header"),
        n("Product_by_month").alias("n_month"),
        F.count_if(listed).alias("n_listed"),
    )


# Words of the part names of all scales.
_KINDS = ["large", "red", "blue", "cold", "new", "small", "hot", "old"]
_THINGS = ["plate", "rod", "widget", "gear", "gizmo", "ring", "bolt", "anvil"]


@query(
    f"""WITH {_REPORTS}
    SELECT p_name || ' ' || p % 10 AS grammar, count(*) AS n, count(DISTINCT k) AS n_documents, CAST(sum(p) AS BIGINT) AS permits
    FROM docs JOIN parts USING (k) JOIN part ON p_partkey = p GROUP BY 1"""
)
def classify_many_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grammar for each name of a well and last digit of its number, 640 in all, on every line."""
    grammars = [
        Grammar(f"{kind} {thing} {digit}", rf" *(?P<Permit>\d{{7}}) +(?P<Well>{kind} {thing} #\d*{digit})$")
        for kind in _KINDS for thing in _THINGS for digit in range(10)
    ]
    found = classify_many(explode_lines(render_reports(spark, sf_dir)).select("doc_id", "line"), grammars)
    return found.groupBy("grammar").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("doc_id").alias("n_documents"),
        F.sum(F.col("fields.Permit").cast("bigint")).alias("permits"),
    )


# --- Reports -----------------------------------------------------------------


@query(
    f"""WITH {_REPORTS} SELECT k AS doc_id, CASE WHEN known THEN n_name END AS County, CASE WHEN known THEN r_name END AS Quad,
    CASE WHEN known THEN 'Unassigned' END AS Pool FROM docs"""
)
def parse_county_quad_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_context(render_reports(spark, sf_dir)).select("doc_id", "County", "Quad", "Pool")


@query(
    f"""WITH {_REPORTS}, b AS (SELECT *, CASE WHEN known THEN NOT lost ELSE j > 0 END AS has FROM docs)
    SELECT k AS doc_id, CASE WHEN has THEN s_name END AS Buyer, CASE WHEN has THEN CAST(k AS VARCHAR) END AS Lease,
           CASE WHEN has THEN CASE WHEN k % 2 = 0 THEN 'Gas' ELSE 'Oil' END END AS Type, known AS has_required FROM b"""
)
def parse_buyer_lease_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = document_context(render_reports(spark, sf_dir))
    return context.select("doc_id", "Buyer", "Lease", "Type", "has_required")


@query(
    f"""WITH {_REPORTS} SELECT k AS doc_id, CASE WHEN known THEN permit END AS Permit, CASE WHEN known THEN well END AS Well
    FROM docs"""
)
def well_list_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole list of each document; nothing counts where the required field was not read."""
    context = document_context(render_reports(spark, sf_dir))
    listed = [F.when(F.col("has_required"), F.col(c)).alias(c) for c in ("Permit", "Well")]
    return context.select("doc_id", *listed)


@query(
    f"""WITH {_REPORTS}
    SELECT k AS doc_id, lpad(CAST(p AS VARCHAR), 7, '0') AS Permit, p_name || ' #' || p AS Well
    FROM docs JOIN parts USING (k) JOIN part ON p_partkey = p WHERE known
    UNION ALL SELECT k, NULL, 'Unnumbered well' FROM docs WHERE known AND extra"""
)
def listed_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = listed_items(render_reports(spark, sf_dir), "Permit_Well")
    return items.select("doc_id", "Permit", "Well")


@query(
    f"""WITH {_REPORTS},
    place_ AS (
      SELECT k, 0 AS stage, 1 AS first_line, 1 AS last_line, 1 AS n_lines FROM docs WHERE known
      UNION ALL SELECT k, 1, buyer, buyer, 1 FROM docs WHERE CASE WHEN known THEN NOT lost ELSE j > 0 END
      UNION ALL SELECT k, 2, head, head, 1 FROM docs WHERE known OR j > 0
      UNION ALL SELECT k, 3, head + n - m + 1, head + n, m
                FROM (SELECT *, CASE WHEN known OR j > 0 THEN n ELSE n - 3 END AS m FROM docs)
      UNION ALL SELECT k, 4, head + n + 1, head + n + 1, 1 FROM docs
      UNION ALL SELECT k, 5, head + n + 2, head + n + 2, 1 FROM docs WHERE tab
      UNION ALL SELECT k, 6, head + n + 3, head + n + 3 + ny + CAST(breaks AS BIGINT), ny + 1 FROM docs WHERE tab)
    SELECT k AS doc_id, CAST(stage AS BIGINT) AS stage, CAST(first_line AS BIGINT) AS first_line,
           CAST(last_line AS BIGINT) AS last_line, CAST(n_lines AS BIGINT) AS n_lines FROM place_""",
    name="stage_positions",
)
def stage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = stage_positions(render_reports(spark, sf_dir))
    return spans.select(
        "doc_id", _big("stage"), _big("first_line"), _big("last_line"), _big("n_lines")
    )


@query(f"SELECT * FROM ({ORACLES['stage_positions']}) WHERE stage <= 4")
def stages_that_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan none of whose stages goes on to the end: reading stops after the list's end mark."""
    tasks = TASKS[: TASKS.index("Permit_Well_end") + 1]
    # the pair that would go on to the end names a task that is not there
    plan = build_plan(tasks, ["Permit_Well", "Permit_Well", "", ""], ["Quad", "Buyer"], GRAMMARS)
    spans = stage_positions(render_reports(spark, sf_dir), plan)
    return spans.select("doc_id", *[_big(c) for c in ("stage", "first_line", "last_line", "n_lines")])


@query(ORACLES["stage_positions"])
def split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of documents cut at every line."""
    spans = splits.stage_positions(splits.cut_documents(render_reports(spark, sf_dir), 1))
    return spans.select("doc_id", *[_big(c) for c in ("stage", "first_line", "last_line", "n_lines")])


@query(_WIDE_SQL)
def split_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide report of documents that come in rows of four lines each."""
    return splits.production_wide(splits.cut_documents(render_reports(spark, sf_dir), 4))


@query(_WIDE_SQL, name="production_wide")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_wide(render_reports(spark, sf_dir))


@query(
    f"""WITH {_REPORTS}
    SELECT r_name AS Quad, buyer_name AS Buyer, lpad(CAST(p AS VARCHAR), 7, '0') AS Permit, p_name || ' ' || p AS Well,
           CAST(k AS VARCHAR) AS File
    FROM docs JOIN parts USING (k) JOIN part ON p_partkey = p WHERE known"""
)
def custom_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report described by settings, a pattern under its lower-cased name: the numbered wells as its detail table.

    Detail values with digits lose their ``#``; header values keep it.
    """
    settings = settings_from_config(
        {
            "tasks_list": TASKS[: TASKS.index("Permit_Well") + 1],
            "tasks_branch_from_to_list": "Permit_Well, Numbered_Well",
            "re_numbered_well": r"(?P<Permit>\d{7}) +(?P<Well>.*)",
            "header_list": "Quad, Buyer, <Numbered_Well>, <File>",
        }
    )
    return production_wide(render_reports(spark, sf_dir), settings.plan)


@query(_PACKED_SQL)
def production_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row grammar taken literally: missing and masked cells shift later months."""
    return production_wide(render_reports(spark, sf_dir), default_plan(layout="pack_left"))


_TOUCHING = [f"CASE WHEN masked THEN '' ELSE CAST(m{i} AS VARCHAR) END" if i == 6 else f"CAST(m{i} AS VARCHAR)" for i in range(1, 13)]


@query(
    f"""WITH {_REPORTS},
    c AS (SELECT *, CASE WHEN NOT gap THEN [{", ".join(_TOUCHING)}]
                         WHEN m4 < 10000 THEN [{", ".join([*_TOUCHING[:2], "''", *_TOUCHING[3:]])}]
                         ELSE [{", ".join([*_TOUCHING[:2], *_TOUCHING[3:], "''"])}] END AS c
          FROM docs JOIN rows_ USING (k) WHERE known AND NOT mixed)
    SELECT {_HEAD_SQL}, {", ".join(f"c[{i}] AS {m}" for i, m in enumerate(MONTHS, 1))},
           CAST(tot AS VARCHAR) AS Totals, CAST(k AS VARCHAR) AS File FROM c"""
)
def production_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older grammar in which a # alone may border two cells; a mixed cell is two of them, so no row."""
    return production_wide(render_reports(spark, sf_dir), default_plan(layout="touching"))


@query(
    f"""WITH {_REPORTS}
    SELECT {_HEAD_SQL}, {", ".join(
        f"CASE WHEN masked THEN '#####' ELSE CAST(m6 AS VARCHAR) END AS {m}" if i == 6
        else f"{_cell(i)} AS {m}" for i, m in enumerate(MONTHS, 1))},
      CAST(tot AS VARCHAR) AS Totals, CAST(k AS VARCHAR) AS File
    FROM docs JOIN rows_ USING (k) WHERE known"""
)
def production_masks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_wide(render_reports(spark, sf_dir), default_plan(mask_mode="keep"))


@query(
    f"""WITH {_REPORTS} SELECT {_HEAD_SQL}, {_CELLS_SQL}
    FROM docs JOIN rows_ USING (k) WHERE known AND NOT masked AND NOT gap AND NOT mixed"""
)
def production_numeric_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict older grammar: rows with a masked, mixed or missing cell are refused."""
    return production_wide(render_reports(spark, sf_dir), default_plan(mask_mode="reject"))


@query(
    f"""WITH {_REPORTS}, {_LONG_SQL}
    SELECT k AS doc_id, CAST(year AS BIGINT) AS year, month, volume, is_masked AS masked FROM long_""",
    name="production_long",
)
def production_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = production_long(render_reports(spark, sf_dir))
    return rows.select("doc_id", _big("year"), _big("month"), "volume", "masked")


@query(
    f"""WITH {_REPORTS}, {_LONG_SQL}
    SELECT n_name AS county, CAST(year AS BIGINT) AS year, sum(volume) AS volume, count(volume) AS n_cells
    FROM long_ GROUP BY 1, 2"""
)
def production_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = production_long(render_reports(spark, sf_dir))
    return rows.groupBy("county", _big("year")).agg(
        F.sum("volume").alias("volume"), F.count("volume").alias("n_cells")
    )


@query(
    f"""WITH {_REPORTS}
    SELECT k AS doc_id, yr AS Year, cell FROM docs JOIN rows_ USING (k),
    (VALUES ('Jun'), ('Jul')) AS c (cell) WHERE known AND CASE cell WHEN 'Jun' THEN masked ELSE mixed END"""
)
def masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = production_typed(render_reports(spark, sf_dir))
    year = F.when(F.col("is_total"), F.lit("Totals")).otherwise(F.col("year").cast("string"))
    return rows.select("doc_id", year.alias("Year"), F.explode("masked").alias("cell"))


@query(
    f"""WITH {_REPORTS}
    SELECT k AS doc_id, ny AS n_years, CAST(tot AS DOUBLE) AS total,
           CAST(tot - CASE WHEN masked THEN m6 ELSE 0 END - CASE WHEN gap THEN m3 ELSE 0 END AS DOUBLE) AS month_sum,
           CAST(CASE WHEN masked THEN m6 ELSE 0 END + CASE WHEN gap THEN m3 ELSE 0 END AS DOUBLE) AS difference
    FROM docs JOIN rows_ USING (k) WHERE known AND yr = 'Totals'"""
)
def totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of all years added up, against the total of the totals row."""
    rows = production_typed(render_reports(spark, sf_dir))
    is_total = F.col("is_total")
    months = sum((F.coalesce(F.col(m.lower()), F.lit(0.0)) for m in MONTHS[1:]), F.coalesce(F.col(MONTHS[0].lower()), F.lit(0.0)))
    sums = rows.groupBy("doc_id").agg(
        F.count_if(~is_total).alias("n_years"),
        F.sum(F.when(~is_total, months)).alias("month_sum"),
        F.sum(F.when(is_total, F.col("totals"))).alias("total"),
    )
    return sums.withColumn("difference", F.col("total") - F.col("month_sum"))


@query(f"WITH {_REPORTS}, {_events_sql(False)} SELECT kind, task, level, count(*) AS n FROM events_ GROUP BY 1, 2, 3")
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = at_least(diagnostics(render_reports(spark, sf_dir)), "INFO")
    return events.groupBy("kind", "task", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_REPORTS}, {_events_sql(False)} SELECT doc_id, count(*) AS n FROM events_ WHERE level = 'WARNING' GROUP BY 1")
def warnings_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings only; masked cells are a lower level."""
    return at_least(diagnostics(render_reports(spark, sf_dir)), "WARNING").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_REPORTS} SELECT k AS doc_id, n_lines, CASE WHEN known AND tab THEN ny + 1 ELSE 0 END AS n_rows,
    CASE WHEN NOT known THEN 'rest_skipped' WHEN tab THEN 'rows' ELSE 'nothing_before_table' END AS outcome FROM docs"""
)
def required_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_outcomes(render_reports(spark, sf_dir))


@query(f"WITH {_REPORTS}, {_events_sql(True)} SELECT doc_id, line_no, task, kind, level FROM events_")
def strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the literal grammar, documents without a county line included."""
    events = diagnostics(render_reports(spark, sf_dir), default_plan(layout="pack_left"))
    line = F.coalesce("line_no", F.lit(0)).cast("bigint")  # 0: about the document, not a line
    return events.select("doc_id", line.alias("line_no"), "task", "kind", "level")


@query(ORACLES["strict_parse"])
def split_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the literal grammar, of documents cut at every line."""
    parts = splits.cut_documents(render_reports(spark, sf_dir), 1)
    events = splits.diagnostics(parts, default_plan(layout="pack_left"))
    line = F.coalesce("line_no", F.lit(0)).cast("bigint")
    return events.select("doc_id", line.alias("line_no"), "task", "kind", "level")


def _landed_files(docs: DataFrame, folder: str) -> DataFrame:
    """Each document as a text file of its own: ``report=<number>/part-*.txt``."""
    docs.select(F.col("doc_id").alias("report"), "value").write.mode("append").partitionBy("report").text(folder)


_FILE_NUMBER = r"report=(\d+)/"


@query(_WIDE_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed as files, parsed by a stream that stops when all are read."""
    folder = shared_folder(spark)
    docs = render_reports(spark, sf_dir).select(F.col("doc_id").cast("string"), "value")
    docs.write.parquet(f"{folder}/landing")
    stream = stream_documents(spark, f"{folder}/landing")
    ingest(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("doc_id", "line_no")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in which every third document with a table has a stray byte before its totals."""
    docs = render_reports(spark, sf_dir)
    at = F.locate("\n  Totals", F.col("value"))
    head, tail = F.substring(F.col("value"), F.lit(1), at), F.substring(F.col("value"), at + 1, F.char_length("value"))
    stray = F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("FF")), F.encode(tail, "UTF-8")).cast("string")
    return docs.select("doc_id", F.when((F.col("doc_id") % 3 == 0) & (at > 0), stray).otherwise(F.col("value")).alias("value"))


# Reading ends before the totals; the last year then has no line after it, so it is no row either.
_CUT_SQL = f"""WITH {_REPORTS}, last AS (SELECT k, CAST(max(y) AS VARCHAR) AS y FROM monthly GROUP BY 1)
SELECT {_HEAD_SQL}, {_CELLS_SQL} FROM docs JOIN rows_ USING (k) JOIN last USING (k)
WHERE known AND NOT (k % 3 = 0 AND yr IN ('Totals', last.y))"""


@query(_CUT_SQL)
def undecodable_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are read up to their first undecodable line; rows before it stay."""
    return production_wide(cut_at_bad_bytes(_damaged(spark, sf_dir)))


@query(
    f"""WITH {_REPORTS} SELECT k AS doc_id, head + n + 3 + ny + CAST(breaks AS BIGINT) AS line_no, 'WARNING' AS level
    FROM docs WHERE known AND tab AND k % 3 = 0"""
)
def undecodable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = diagnostics(cut_at_bad_bytes(_damaged(spark, sf_dir))).where("kind = 'undecodable'")
    return events.select("doc_id", _big("line_no"), "level")


@query(_WIDE_BY_SUPPLIER)
def reports_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per report, found by pattern below a folder, as the reports come."""
    folder = f"{shared_folder(spark)}/reports"
    _landed_files(render_reports(spark, sf_dir, by_brand=False), folder)
    files = readers.read_reports(spark, folder, "*.txt")
    number = F.regexp_extract("doc_id", _FILE_NUMBER, 1)
    return production_wide(files.select(number.alias("doc_id"), "value"))


@query(
    f"""WITH wide AS ({_WIDE_SQL})
    SELECT {", ".join(f"coalesce({c}, '') AS {c}" for c in default_plan().columns)} FROM wide"""
)
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written CSV, read back as text."""
    folder = f"{shared_folder(spark)}/report.csv"
    plan = default_plan()
    sinks.write_csv(production_wide(render_reports(spark, sf_dir), plan), plan.columns, folder)
    schema = ", ".join(f"`{c}` string" for c in plan.columns)
    back = spark.read.option("header", True).option("escape", '"').schema(schema).csv(folder)
    return sinks.csv_ready(back, plan.columns)


@query(_WIDE_BY_SUPPLIER)
def stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read by a stream; an unfinished ``.part`` file beside them is not read."""
    folder = shared_folder(spark)
    docs = render_reports(spark, sf_dir, by_brand=False)
    _landed_files(docs, f"{folder}/landing")
    unfinished = docs.orderBy("doc_id").limit(1).select(F.concat("value", F.lit("\n")).alias("value"))
    unfinished.coalesce(1).write.option("compression", "none").format("text").save(f"{folder}/unfinished")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = files.Path(folder).getFileSystem(conf)
    (part,) = [x.getPath() for x in store.globStatus(files.Path(f"{folder}/unfinished/part-*"))]
    files.FileUtil.copy(store, part, store, files.Path(f"{folder}/landing/late.txt.part"), False, conf)
    ingest(stream_reports(spark, f"{folder}/landing"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").drop("doc_id", "line_no")
    return rows.withColumn("File", F.regexp_extract("File", _FILE_NUMBER, 1))


@query(f"{_WIDE_SQL} AND k NOT IN (SELECT doc_id FROM labels)")
def stream_skip_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that leaves out documents another job has processed: those whose number has labels."""
    folder = shared_folder(spark)
    render_reports(spark, sf_dir).select(F.col("doc_id").cast("string"), "value").write.parquet(f"{folder}/landing")
    _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string")).write.parquet(f"{folder}/done")
    stream = stream_documents(spark, f"{folder}/landing")
    ingest_new(stream, f"{folder}/done", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("doc_id", "line_no", "batch")


@query(_WIDE_SQL)
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which every other one lands again, in a later run of the stream."""
    folder = shared_folder(spark)
    docs = render_reports(spark, sf_dir).select(F.col("doc_id").cast("string"), "value")
    docs.write.parquet(f"{folder}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{folder}/docs")
    schema = "doc_id string, value string, landed timestamp"
    for hour, part in enumerate((docs.where("doc_id % 3 < 2"), docs.where("doc_id % 2 = 0 OR doc_id % 3 = 2"))):
        landed = F.to_timestamp(F.lit(f"2024-01-01 0{hour}:00:00"))
        part.withColumn("landed", landed).write.mode("append").parquet(f"{folder}/landing")
        stream = stream_documents(spark, f"{folder}/landing", schema)
        keyed.ingest_once(stream, f"{folder}/out", f"{folder}/checkpoint", "landed").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("doc_id", "line_no")


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS nation, octet_length(encode(n_name)) + 1 AS length, true AS recent FROM nation"""
)
def landing_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and time of landed files; no content is read."""
    folder = f"{shared_folder(spark)}/nations"
    _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(folder)
    files = readers.read_landing(spark, folder, recursive=True)
    return files.select(
        F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("bigint").alias("nation"),
        "length",
        (F.col("modificationTime") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("recent"),
    )


@query(
    f"""WITH {_REPORTS}, first AS (SELECT min(CAST(k AS VARCHAR)) AS k FROM docs)
    SELECT k || '+.csv' AS planned, 'errorifexists' AS mode, k || '+_(1).csv' AS second, 'errorifexists' AS second_mode,
           k || '+.csv' AS small, 'overwrite' AS small_mode, n FROM first, (SELECT count(*) AS n FROM docs)"""
)
def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output's name after the first input, before and after it is there, and when it may be replaced."""
    folder = shared_folder(spark)
    docs = render_reports(spark, sf_dir).select(F.format_string("in/%d.txt", "doc_id").alias("doc_id"))
    name = sinks.output_name(docs, "<File_in>")
    planned, mode = sinks.free_output(spark, f"{folder}/{name}")
    sinks.write_csv(docs, ["doc_id"], planned, mode)
    second, second_mode = sinks.free_output(spark, f"{folder}/{name}")
    small, small_mode = sinks.free_output(spark, f"{folder}/{name}", min_size_to_overwrite=1 << 40)
    names = {"planned": planned, "mode": mode, "second": second, "second_mode": second_mode, "small": small, "small_mode": small_mode}
    written = spark.read.option("header", True).csv(planned).agg(F.count(F.lit(1)).alias("n"))
    return written.select(*[F.lit(v.rpartition("/")[2]).alias(k) for k, v in names.items()], "n")


@query(f"WITH {_REPORTS}, {_events_sql(False)} SELECT doc_id, kind, count(*) AS n FROM events_ GROUP BY ALL")
def diagnostics_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as it is kept on disk, by kind."""
    folder = f"{shared_folder(spark)}/log"
    sinks.write_diagnostics(diagnostics(render_reports(spark, sf_dir)), folder)
    return spark.read.parquet(folder).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_REPORTS} SELECT row_number() OVER (ORDER BY k, yr = 'Totals', yr) AS n, CAST(k AS VARCHAR) AS File, yr AS Year
    FROM docs JOIN rows_ USING (k) WHERE known"""
)
def report_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written in order, and its rows numbered as they stand in the files."""
    folder = f"{shared_folder(spark)}/report.csv"
    plan = default_plan()
    rows = production_wide(render_reports(spark, sf_dir), plan, position=True)
    sinks.write_csv(rows, plan.columns, folder, order_by=["doc_id", "line_no"], compression="gzip")
    schema = ", ".join(f"`{c}` string" for c in plan.columns)
    back = spark.read.option("header", True).option("escape", '"').schema(schema).csv(folder)
    place = back.select(
        "File", "Year", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return numbered(place, [], ["name", "block", "at"], "n").select("n", "File", "Year")


@query(
    f"""WITH {_REPORTS} SELECT k AS doc_id, len(string_split(s_name, '#')) AS n_parts, CASE WHEN tab THEN ny ELSE 0 END AS n_years FROM docs"""
)
def document_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own function over whole documents."""

    def count(doc_id, text: str) -> pd.DataFrame:
        buyer = re.search(r"Buyer:  (\S+)", text).group(1)
        years = re.findall(r"^[\f ]+\d{4} ", text, flags=re.MULTILINE)
        return pd.DataFrame(
            {"doc_id": [doc_id], "n_parts": [len(buyer.split("#"))], "n_years": [len(years)]}
        )

    return per_document(
        render_reports(spark, sf_dir), count, "doc_id bigint, n_parts bigint, n_years bigint"
    )


# --- Text and pages ----------------------------------------------------------


@query(
    rf"""WITH {_LINES}
    SELECT doc_id, line_no,
           CASE WHEN contains(line, '#') AND regexp_matches(line, '\p{{Nd}}') THEN replace(line, '#', '')
                ELSE line END AS cleaned
    FROM lines"""
)
def hash_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(_documents(spark, sf_dir))
    return lines.select(
        "doc_id", _big("line_no"), text_fn.hash_cleanup(F.col("line")).alias("cleaned")
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("html")
    return pages.select(
        F.explode(page_fn.attribute_values(F.col("html"), "a", "href")).alias("option")
    )


_LINKS = """links AS (SELECT unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS option FROM pages)"""


@query(
    f"""WITH {_LINKS}, d AS (SELECT option, count(*) AS copies FROM links GROUP BY 1)
    SELECT option, copies, row_number() OVER (ORDER BY option) AS n FROM d"""
)
def page_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _links(spark, sf_dir).groupBy("option").agg(F.count(F.lit(1)).alias("copies"))
    return enumerated(counted, "option")


@query(f"WITH {_LINKS} SELECT count(DISTINCT option) AS n_distinct, count(*) AS n_total FROM links")
def option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.option_counts(_links(spark, sf_dir))


@query(
    """SELECT o_orderpriority || ' & ' || substr(o_orderpriority, 3, 1) || ' <' || chr(8594) || '>' AS option,
              count(DISTINCT (o_custkey)) AS copies FROM orders
    JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def form_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the option boxes of all result pages."""
    pages = render_result_pages(spark, sf_dir)
    options = pages.select(F.explode(page_fn.option_values(F.col("by_well"))).alias("option"))
    return options.groupBy("option").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """SELECT c_custkey, '/c/' || c_custkey || '?a=1&b="' || replace(c_name, '#', '?') || '"&nope;' AS target FROM customer"""
)
def link_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the links of all result pages, as a parser gives them."""
    pages = render_result_pages(spark, sf_dir)
    found = page_fn.attribute_values(F.col("by_permit"), "a", "href")
    return pages.select("c_custkey", F.explode(found).alias("target"))


@query(
    """SELECT option, row_number() OVER (ORDER BY option) AS n
    FROM (SELECT DISTINCT p_name || ', ' || p_type AS option FROM part)"""
)
def options_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with commas, written as lines below a header and loaded again."""
    folder = f"{shared_folder(spark)}/options.csv"
    part = _table(spark, sf_dir, "part").select(F.concat_ws(", ", "p_name", "p_type").alias("option"))
    sinks.write_options(worklist.distinct_options(part), folder, header="option")
    return readers.read_options_list(spark, folder).select("option", _big("n"))


@query(f"WITH {_LINKS} SELECT option, row_number() OVER (ORDER BY option) AS n FROM (SELECT DISTINCT option FROM links)")
def options_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different options written as a JSON list and loaded again."""
    folder = f"{shared_folder(spark)}/options.json"
    sinks.write_options_json(worklist.distinct_options(_links(spark, sf_dir)), folder)
    return readers.read_options_json(spark, folder).select("option", _big("n"))


@query(
    """WITH t AS (SELECT page_id, url, trim(regexp_replace(
      replace(replace(replace(replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS title FROM pages)
    SELECT page_id, title, contains(title, 'the') AND contains(url, '/en/') AS is_page FROM t"""
)
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html, url = F.col("html"), F.col("url")
    return pages.select(
        "page_id",
        page_fn.title(html).alias("title"),
        page_fn.is_page(html, url, "the", F.lit("/en/")).alias("is_page"),
    )


@query("""SELECT c_custkey, 'Wells & <b> of ' || replace(c_name, '#', '?') || ' !' AS title FROM customer""")
def result_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all result pages, whose comments and scripts hold others."""
    return render_result_pages(spark, sf_dir).select("c_custkey", page_fn.title(F.col("by_well")).alias("title"))


@query(
    """WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT c_custkey,
           CASE WHEN o_custkey IS NULL THEN 'no_data' WHEN c_acctbal >= 0 THEN 'data' ELSE 'no_table' END AS by_well,
           CASE WHEN o_custkey IS NULL THEN 'no_data' WHEN c_acctbal >= 0 THEN 'data' ELSE 'no_table' END AS by_permit
    FROM customer LEFT JOIN o ON c_custkey = o_custkey"""
)
def page_data_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = render_result_pages(spark, sf_dir)
    return pages.select(
        "c_custkey",
        page_fn.page_state(F.col("by_well"), by_well=True).alias("by_well"),
        page_fn.page_state(F.col("by_permit"), by_well=False).alias("by_permit"),
    )


@query(
    r"""WITH u AS (SELECT page_id, split_part(url, '?', 1) AS head, url FROM pages),
    r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
                 CASE WHEN instr(head, '://') > 0 THEN substr(head, instr(head, '://') + 3) ELSE '' END AS cut FROM u),
    b AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS base FROM r)
    SELECT page_id, replace(rest, '/', '-') || '--wellnm' AS folder, replace(cut, '/', '-') AS cut_folder,
           base, CASE WHEN regexp_matches(base, '[^.].*\.[^.]*$') THEN regexp_extract(base, '^(.*)\.[^.]*$', 1) ELSE base END AS stem,
           url || '&API=' || page_id AS option_url
    FROM b"""
)
def dataset_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    return pages.select(
        "page_id",
        text_fn.dataset_folder(url, "--wellnm").alias("folder"),
        text_fn.dataset_folder(url, cut_at="?").alias("cut_folder"),
        text_fn.base_name(url).alias("base"),
        text_fn.stem(url).alias("stem"),
        text_fn.option_url(F.concat(url, F.lit("&API=")), F.col("page_id").cast("string")).alias("option_url"),
    )


# --- Work lists --------------------------------------------------------------

def _document_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", "doc_id").alias("option"))


def _saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every labelled document; about two of five documents have labels."""
    options = _document_options(spark, sf_dir)
    saved = options.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    return saved.select(F.concat("option", F.lit(".xls")).alias("file_name"))


_WORK = """options AS (SELECT doc_id, source || ' ' || doc_id AS option FROM documents),
saved AS (SELECT option FROM options WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(f"WITH {_WORK} SELECT option FROM options EXCEPT SELECT option FROM saved")
def worklist_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.remaining(_document_options(spark, sf_dir), _saved_files(spark, sf_dir))


@query(
    f"""WITH {_WORK}, rest AS (SELECT option FROM options EXCEPT SELECT option FROM saved)
    SELECT (SELECT count(*) FROM options) AS n_listed, (SELECT count(*) FROM rest) AS n_remaining"""
)
def worklist_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.worklist_size(_document_options(spark, sf_dir), _saved_files(spark, sf_dir))


@query(
    """WITH l AS (SELECT row_number() OVER (ORDER BY c_name) AS n, c_name AS option FROM customer)
    SELECT n, option, lpad(CAST(n AS VARCHAR), 6, ' ') || '. ' || option || ' ' AS label
    FROM l WHERE n >= (SELECT min(n) FROM l WHERE option = 'Customer#000000042')"""
)
def worklist_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("option"))
    listed = enumerated(options, "option")
    resumed = worklist.resume_from(listed, "Customer#000000042")
    return worklist.with_label(resumed).select("n", "option", "label")


@query(
    """WITH a AS (SELECT DISTINCT 'user ' || doc_id AS listed, doc_id AS position FROM labels),
    f AS (SELECT arg_min(listed, position) AS first_option FROM a)
    SELECT event_id, 'user ' || user_id AS option, coalesce(listed, first_option) AS chosen, listed IS NULL AS fell_back
    FROM events LEFT JOIN a ON listed = 'user ' || user_id, f"""
)
def option_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of all events as requests; those whose number has labels are available."""
    named = lambda c: F.concat(F.lit("user "), F.col(c).cast("string"))
    labels = _table(spark, sf_dir, "labels").select(named("doc_id").alias("listed"), F.col("doc_id").alias("position"))
    events = _table(spark, sf_dir, "events")
    return worklist.with_fallback(events.select("event_id", named("user_id").alias("option")), labels)


@query(
    r"""WITH req AS (SELECT p_partkey AS n, p_name || '/' || p_type AS option,
                       regexp_replace(p_name || '/' || p_type, '[^\p{L}\p{N}\p{Z}\s_\-+#&,;.()'']+', '_', 'g') AS stem FROM part),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n) AS r FROM req),
    fam AS (SELECT stem, count(*) AS c FROM req GROUP BY 1),
    used AS (SELECT DISTINCT stem, p_size AS number FROM req JOIN part ON p_partkey = n),
    cand AS (SELECT stem, unnest(range(0, c + 60)) AS number FROM fam),
    free AS (SELECT stem, number, row_number() OVER (PARTITION BY stem ORDER BY number) AS r
             FROM cand ANTI JOIN used USING (stem, number))
    SELECT n, option, number,
           stem || CASE WHEN number > 0 THEN '_(' || number || ')' ELSE '' END || '.xls' AS file_name
    FROM ranked JOIN free USING (stem, r)"""
)
def filename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.plan_file_names(*_file_requests(spark, sf_dir))


@query(ORACLES["filename_plan"])
def stream_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for requests that come in three batches, each read by a stream started anew."""
    folder = shared_folder(spark)
    requests, existing = _file_requests(spark, sf_dir)
    names.open_book(existing, f"{folder}/book")
    end = requests.agg(F.max("n") + 1).scalar()
    cut = requests.withColumn("third", F.floor(F.col("n") * 3 / end))
    for third in range(3):
        cut.where(F.col("third") == third).drop("third").write.mode("append").parquet(f"{folder}/requests")
        stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/requests")
        names.stream_names(stream, f"{folder}/book", f"{folder}/checkpoint").awaitTermination()
    return names.planned(spark, f"{folder}/book").drop("batch")


def _file_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part")
    option = F.concat_ws("/", "p_name", "p_type")
    requests = part.select(F.col("p_partkey").alias("n"), option.alias("option"), F.lit(".xls").alias("ext"))
    # each part's size is a number already in use under its name
    number = F.col("p_size")
    suffix = F.when(number > 0, F.format_string("_(%d)", number)).otherwise(F.lit(""))
    existing = part.select(F.concat(text_fn.safe_file_name(option), suffix, F.lit(".xls")).alias("file_name")).distinct()
    return requests, existing


# --- Landing folder and attempts ---------------------------------------------

_STARTED = "2024-01-03 00:00:00"


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a file log: value is the size, ts the time."""
    events = _table(spark, sf_dir, "events")
    ext = F.when(F.col("event_type") == "error", F.lit(".part")).otherwise(F.lit(".xls"))
    return events.select(
        "user_id",
        F.concat(F.lit("temp/"), F.col("event_id").cast("string"), ext).alias("path"),
        F.floor("value").cast("bigint").alias("length"),
        F.col("ts").alias("modificationTime"),
    )


_FILES = """files AS (SELECT user_id,
  'temp/' || event_id || CASE WHEN event_type = 'error' THEN '.part' ELSE '.xls' END AS path,
  CAST(floor(value) AS BIGINT) AS length, ts AS modificationTime FROM events)"""


@query(
    f"""WITH {_FILES},
    s AS (SELECT *, CASE WHEN modificationTime < TIMESTAMP '{_STARTED}'
                         THEN CASE WHEN length > 20 THEN 'stale' ELSE 'discard' END
                         WHEN path LIKE '%.part' THEN 'partial' WHEN length <= 10 THEN 'not_ready' ELSE 'ready' END AS state
          FROM files)
    SELECT path, length, state, CASE WHEN state = 'stale' THEN '_' || substr(path, 6) END AS moved_as FROM s"""
)
def landing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.lit(_STARTED).cast("timestamp")
    states = landing.landing_state(_event_files(spark, sf_dir), started)
    return states.select("path", "length", "state", "moved_as")


@query(
    f"""WITH {_FILES}
    SELECT user_id, arg_max(path, (modificationTime, path)) AS path FROM files GROUP BY 1"""
)
def landing_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.newest_file(_event_files(spark, sf_dir), ["user_id"]).select("user_id", "path")


@query(
    """WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'no_data'
                         WHEN 'signup' THEN 'not_found' ELSE 'retry' END AS status FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM a QUALIFY rank <= 3),
    g AS (SELECT user_id, min(rank) FILTER (status <> 'retry') AS ended,
                 arg_min(status, rank) FILTER (status <> 'retry') AS status, max(rank) AS seen FROM r GROUP BY 1)
    SELECT user_id, CASE WHEN ended IS NOT NULL THEN status WHEN seen >= 3 THEN 'failed' ELSE 'pending' END AS outcome,
           coalesce(ended, seen) AS n_attempts FROM g"""
)
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "purchase", "ok")
        .when(F.col("event_type") == "view", "no_data")
        .when(F.col("event_type") == "signup", "not_found")
        .otherwise("retry")
    )
    log = _table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return worklist.attempt_rollup(log, option="user_id", attempt="event_id")


def _in_runs(spark: SparkSession, log: DataFrame, most: int, judge) -> DataFrame:
    """The outcome of each user from a log that lands in three parts, out of order, each read by a stream started anew."""
    folder = shared_folder(spark)
    for part in (2, 0, 1):
        log.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
        found = keyed.first_events(stream, "user_id", "event_id", "status", most, judge)
        keyed.keep_latest(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return keyed.latest(spark.read.parquet(f"{folder}/out"), "user_id")


@query(ORACLES["attempt_rollup"])
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of attempts, as the log of them arrives."""
    status = (
        F.when(F.col("event_type") == "purchase", "ok")
        .when(F.col("event_type") == "view", "no_data")
        .when(F.col("event_type") == "signup", "not_found")
        .otherwise("retry")
    )
    log = _table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return _in_runs(spark, log, worklist.MAX_ATTEMPTS, keyed.attempt_outcome).withColumnRenamed("n", "n_attempts")


@query(
    """WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'partial' WHEN floor(value) <= 100 THEN 'not_ready' ELSE 'ready' END AS state FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM p QUALIFY k <= 6),
    g AS (SELECT user_id, min(k) FILTER (state = 'ready') AS landed, count(*) AS seen, bool_or(state = 'partial') AS part FROM r GROUP BY 1)
    SELECT user_id, CASE WHEN landed IS NOT NULL THEN 'landed' WHEN seen >= 6 THEN 'gave_up' WHEN part THEN 'partial' ELSE 'started' END AS outcome,
           coalesce(landed, seen) AS n_polls FROM g"""
)
def stream_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks at a folder, replayed from the events: a file lands, or is given up after six looks."""
    state = F.when(F.col("event_type") == "error", "partial").when(F.floor("value") <= 100, "not_ready").otherwise("ready")
    log = _table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("status"))
    return _in_runs(spark, log, 6, keyed.wait_outcome).withColumnRenamed("n", "n_polls")
