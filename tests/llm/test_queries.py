from __future__ import annotations

import re

import duckdb
import pytest
from check_oracles import connect, differences
from test_copies import plain_classes, plain_hits, plain_near

from reportlake.llm import language_id, pieces, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, database, name):
    rows = queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert len(rows) > 0
    if name in queries.ORACLES:
        assert differences(rows, database.execute(queries.ORACLES[name]).df()) == ""


def test_pipeline_equals_plain_steps(spark):
    """Every stage on a small table against its plain version."""
    import corpus_pipeline

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.train(source.where(~language_id.held_out(source["doc_id"])))
    named = {r["doc_id"] for r in language_id.identify(source, model).where("lang_pred <> 'und'").collect()}
    assert named == {d for d, t in docs if re.search(r"[^\W\d_]", t or "")}
    rows = [r for r in docs if r[0] in named]
    kept = {d for d, _, _, stays, _ in plain_classes(rows) if stays}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, near in zip(rows, plain_near(rows)) if near[0] == near[1]]
    rows = [r for r, hit in zip(rows, plain_hits(rows, items)) if not hit[-1]]
    encoder = pieces.Encoder(pieces.read_model())
    want = {d: [int.from_bytes(encoder.encode(t)[i : i + 4], "little") for i in range(0, len(encoder.encode(t)), 4)] for d, t in rows}
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == [*source.columns, "piece_ids"]
    assert {r["doc_id"]: list(r["piece_ids"]) for r in got.collect()} == want
    assert len(want) < len(docs)


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
