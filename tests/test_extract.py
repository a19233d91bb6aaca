from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from plain_reader import Reader, row_cells
from random_reports import odd_row, report, row
from reportlake.functions import cells
from reportlake.operators.diagnostics import diagnostics, document_outcomes
from reportlake.operators.extract import document_context, production_wide
from reportlake.plans.grammar import BRANCHES, GRAMMARS, HEADER, Grammar, WideRow, build_plan, default_plan

N_DOCS = 1200


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    texts = {f"d{i:04d}": report(rng) for i in range(N_DOCS)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, value string").repartition(8)
    return texts, docs


def other_plan():
    """Skips before repeating stages, two lists, and a loose final grammar."""
    grammars = dict(GRAMMARS)
    grammars["Line"] = Grammar("Line", r" *(?P<Year>\d{2,4}|Totals) +(?:(?P<Jan>\d+)|#+)")
    grammars["Product_by_month"] = WideRow("Product_by_month", layout="pack_left")
    tasks = ["County_Quad_Pool", "Buyer_Lease_Type_Active", "", "Permit_Well_header", "", "Permit_Well"]
    tasks += ["Product_by_month_header", "", "Totals_row"]
    branches = ["Permit_Well", "Permit_Well", "Totals_row", "Line"]
    header = ["Buyer", "Permit", "Well", "<Line>", "<File>"]
    return build_plan(tasks, branches, header, grammars)


def endless_free_plan():
    """No detail stage: reading ends after the last task and gives no rows."""
    grammars = dict(GRAMMARS)
    tasks = ["County_Quad_Pool", "Buyer_Lease_Type_Active", "Permit_Well_header"]
    return build_plan(tasks, [], ["Buyer"], grammars, header_stage=None)


@pytest.mark.parametrize("make", [lambda: default_plan(layout="pack_left"), other_plan])
def test_rows_equal_plain_reading(corpus, make):
    texts, docs = corpus
    plan = make()
    got = {}
    for r in production_wide(docs, plan, position=True).collect():
        values = {k: v for k, v in r.asDict().items() if k not in ("doc_id", "File")}
        got.setdefault(r.doc_id, []).append(values)
    n = 0
    for key, text in texts.items():
        expected = []
        for values in Reader(text, plan).rows:
            expected.append({"line_no": values["line_no"], **{c: values.get(c) for c in plan.columns if c != "File"}})
        found = sorted(got.get(key, []), key=lambda v: v["line_no"])
        assert found == sorted(expected, key=lambda v: v["line_no"]), text
        n += len(expected)
    assert n > 300


@pytest.mark.parametrize("make", [lambda: default_plan(layout="pack_left"), other_plan])
def test_events_equal_plain_reading(corpus, make):
    texts, docs = corpus
    plan = make()
    got = {}
    for r in diagnostics(docs, plan).where("kind not in ('masked_cell')").collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.task, r.kind))
    kinds = set()
    for key, text in texts.items():
        reader = Reader(text, plan)
        expected = list(reader.events)
        if not reader.reached and not reader.stopped:
            expected.append((None, plan.detail.name, "nothing_before_table"))
        found = got.get(key, [])
        order = lambda e: (e[0] or 0, str(e[1]), e[2])
        assert sorted(found, key=order) == sorted(expected, key=order), text
        kinds |= {e[2] for e in expected}
    assert {"skipped_bad_line", "no_match", "bad_parameters", "rest_skipped", "nothing_before_table"} <= kinds


def test_outcomes_count_rows(corpus):
    texts, docs = corpus
    plan = default_plan(layout="pack_left")
    got = {r.doc_id: (r.n_rows, r.outcome) for r in document_outcomes(docs, plan).collect()}
    for key, text in texts.items():
        reader = Reader(text, plan)
        outcome = "rows" if reader.rows else "rest_skipped" if reader.stopped else "nothing_before_table"
        assert got[key] == (len(reader.rows), outcome), text


def test_context_without_a_final_stage(corpus):
    texts, docs = corpus
    plan = endless_free_plan()
    got = {r.doc_id: r.Buyer for r in document_context(docs, plan).collect()}
    for key, text in texts.items():
        assert got[key] == Reader(text, plan).context.get("Buyer")


def test_packed_rows_equal_search(spark):
    rng = random.Random(5)
    lines = sorted({row(rng) for _ in range(2500)} | {odd_row(rng) for _ in range(2500)})
    df = spark.createDataFrame([(x,) for x in lines], "l string").repartition(8)
    line = F.col("l")
    matched = cells.is_packed_row(line)
    out = df.select("l", F.when(matched, cells.packed_row(line)).alias("c")).collect()
    n = 0
    for r in out:
        expected = row_cells(r.l)
        assert r.c == (None if expected is None else list(expected.values())), r.l
        n += expected is not None
    assert 500 < n < len(lines) - 500


def test_column_rows_hold_all_packed_rows(spark):
    rng = random.Random(6)
    lines = sorted({row(rng) for _ in range(2000)} | {odd_row(rng) for _ in range(2000)})
    df = spark.createDataFrame([(x,) for x in lines], "l string").repartition(8)
    line = F.col("l")
    places = cells.header_places(F.lit(" Year     Jan      Feb      Mar      Apr      May      Jun      Jul      Aug      Sep      Oct      Nov      Dec   Totals"))
    out = df.select(
        "l",
        cells.is_packed_row(line).alias("packed"),
        cells.is_column_row(line).alias("column"),
        F.when(cells.is_column_row(line), cells.column_row(line, places)).alias("c"),
    ).collect()
    for r in out:
        assert not r.packed or r.column, r.l
        if r.column:
            assert len(r.c) == 14, r.l
            # No value is lost or invented, and order is kept.
            given = re.sub(r"[# ]+", " ", re.sub(r"^[^\dT]*(\d{2,4}|Totals)", "", r.l)).split()
            kept = re.sub(r"[# ]+", " ", " ".join(r.c[1:])).split()
            assert kept == given, r.l


SAMPLE_HEADER = "  Year      Jan      Feb      Mar      Apr      May      Jun      Jul      Aug      Sep      Oct      Nov      Dec   Totals"


def aligned(year, values):
    return f"  {year}" + "".join(f" {v:>8}" for v in values)


@pytest.mark.parametrize(
    "mode, expected",
    [("blank", ["", "60"]), ("keep", ["#######", "60"]), ("reject", None)],
)
def test_mask_modes(spark, mode, expected):
    values = [str(i * 10) for i in range(1, 13)] + ["780"]
    values[5], values[6] = "#######", "6#0"
    text = "\n".join(
        ["A County; B Quad; C Field Pool", "Buyer: X Lease#: 1 Production Type Oil", "w", "Permit Well Name",
         "1 One", " Edit Wells", SAMPLE_HEADER, aligned(2012, values), "end"]
    )
    docs = spark.createDataFrame([("d", text)], "doc_id string, value string")
    rows = production_wide(docs, default_plan(mask_mode=mode)).collect()
    if expected is None:
        assert rows == []
    else:
        assert [rows[0].Jun, rows[0].Jul] == expected
        assert (rows[0].May, rows[0].Aug, rows[0].Totals) == ("50", "80", "780")


def test_missing_month_by_header_and_packed(spark):
    values = [str(i * 10) for i in range(1, 13)] + ["780"]
    values[3] = ""
    line = aligned(2012, values)
    df = spark.createDataFrame([(line, SAMPLE_HEADER)], "l string, h string")
    out = df.select(
        cells.column_row(F.col("l"), cells.header_places(F.col("h"))).alias("by_header"),
        cells.packed_row(F.col("l")).alias("packed"),
    ).first()
    assert out.by_header == ["2012", *values]
    assert out.packed == ["2012", *values[:3], *values[4:12], "", "780"]


def test_mask_run_over_several_columns(spark):
    values = [str(i * 10) for i in range(1, 13)] + ["780"]
    line = aligned(2012, values)
    begin = line.index(" 30") + 1 - 3
    masked = line[:begin] + "#" * 14 + line[begin + 14 :]
    df = spark.createDataFrame([(masked, SAMPLE_HEADER)], "l string, h string")
    row_ = df.select(cells.column_row(F.col("l"), cells.header_places(F.col("h"))).alias("c")).first().c
    assert len(row_) == 14 and row_[1:3] == ["10", "20"] and row_[-1] == "780"
    assert all(set(c) == {"#"} for c in row_[3:5])


def test_touching_rows(spark):
    """Cells bordered by spaces or by # alone; masks are cells without digits."""
    rng = random.Random(8)
    made = {}
    for _ in range(400):
        values = ["#" * rng.randint(1, 9) if rng.random() < 0.15 else str(rng.randint(0, 99999)) for _ in range(12)]
        line = f" {rng.choice(['2007', '98', 'Totals'])}" + " " * rng.randint(1, 13)
        head = line.split()[0]
        for v, following in zip(values, [*values[1:], "1"]):
            border = " " * rng.randint(1, 9) if v[0] == "#" or following[0] == "#" else rng.choice(["#", "##", " ", "    ", "# "])
            line += v + border
        made[line + "7654.3" + rng.choice(["", "#", "##"])] = [head, *[v.strip("#") for v in values], "7654.3"]
    made["2012 1#2 7"] = ["2012", "1", "2", *[""] * 10, "7"]
    no_rows = ["2012", "2012 x", "2012 " + "1 " * 14, "2012 1 2 ##", "name 2012"]
    df = spark.createDataFrame([(x,) for x in [*made, *no_rows]], "l string")
    out = df.select("l", cells.is_touching_row(F.col("l")).alias("m"), cells.touching_row(F.col("l")).alias("c")).collect()
    for r in out:
        assert r.m == (r.l in made), r.l
        assert r.l not in made or r.c == made[r.l], r.l
    text = "\n".join(["A County; B Quad; C Field Pool", "Buyer: X Lease#: 1 Production Type Oil", "w", "Permit Well Name",
                      "1 One", " Edit Wells", SAMPLE_HEADER, next(iter(made)), "end"])
    docs = spark.createDataFrame([("d", text)], "doc_id string, value string")
    row_ = production_wide(docs, default_plan(layout="touching")).first()
    assert [row_[c] for c in ["Year", *cells.CELLS]] == next(iter(made.values()))


def test_branch_may_use_another_grammar():
    plan = other_plan()
    assert [s.name for s in plan.stages][-1] == "Line" and plan.sticky == len(plan.stages) - 1
    assert plan.columns == ("Buyer", "Permit", "Well", "Year", "Jan", "File")
    assert default_plan().columns[:8] == tuple(HEADER[:8]) and len(default_plan().columns) == 23
    assert BRANCHES[0] == "Permit_Well"
