from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracles import connect, differences
from reportlake import catalog

SF_DIR = "/root/testdata/sf0.001"
#: Their SQL takes lists of four lines at least, which the smallest scale does not always have.
LARGER = {"strict_parse", "diagnostics_written", "diagnostics_summary", "warnings_by_document", "stage_positions"}
LARGER |= {"split_parse", "split_positions", "stages_that_end"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    """Every query has SQL, and equals it."""
    sf_dir = "/root/testdata/sf0.01" if name in LARGER else SF_DIR
    rows = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows) > 0
    assert differences(rows, connect(sf_dir).execute(catalog.ORACLES[name]).df()) == ""


def test_every_variant_occurs(spark):
    """Each kind of event, outcome and page state has rows at the scale that is compared."""
    from pyspark.sql import functions as F

    sf_dir = "/root/testdata/sf0.01"
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    kinds = {r[0] for r in run("diagnostics_summary").select("kind").distinct().collect()}
    assert kinds == {"skipped_bad_line", "no_match", "bad_parameters", "nothing_before_table", "rest_skipped", "masked_cell"}
    assert {r[0] for r in run("required_context").select("outcome").distinct().collect()} == {"rows", "rest_skipped", "nothing_before_table"}
    states = run("page_data_state")
    for kind in ("by_well", "by_permit"):
        assert {r[0] for r in states.select(kind).distinct().collect()} == {"data", "no_data", "no_table"}
    hidden = run("totals_reconcile").agg(F.count_if(F.col("difference") > 0), F.count_if(F.col("difference") == 0)).first()
    assert min(hidden) > 100


def test_entry_is_the_wide_report(spark):
    assert len(entry.entry(spark).columns) == 23


def narrow(plan: str) -> bool:
    return "Exchange" not in plan


def test_parsing_needs_no_shuffle(spark, tmp_path):
    """A stored corpus is read, parsed and written without moving documents."""
    from reportlake.operators.diagnostics import diagnostics, document_outcomes
    from reportlake.operators.extract import production_long, production_wide

    docs = spark.createDataFrame([("d", "x")], "doc_id string, value string")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for make in (production_wide, production_long, diagnostics, document_outcomes):
        plan = make(stored)._jdf.queryExecution().executedPlan().toString()
        assert narrow(plan), plan


def test_filters_on_the_key_reach_the_scan(spark, tmp_path):
    from reportlake.operators.extract import production_wide

    docs = spark.createDataFrame([("d", "x")], "doc_id string, value string")
    docs.write.parquet(str(tmp_path / "docs"))
    rows = production_wide(spark.read.parquet(str(tmp_path / "docs")), position=True)
    plan = rows.where("doc_id = 'd'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,d)" in plan
