"""Documents in several rows against the same documents in one."""

from __future__ import annotations

import random

import pytest
from random_reports import report

from reportlake.operators import splits
from reportlake.operators.classify import stage_positions
from reportlake.operators.diagnostics import diagnostics
from reportlake.operators.extract import production_wide
from reportlake.operators.lines import explode_lines
from reportlake.plans.grammar import TASKS, default_plan, settings_from_config
from reportlake.sources.readers import read_reports, read_segments

#: A plan that ends: no stage goes on to the end of the document.
ENDING = settings_from_config(
    {"tasks_list": ", , ".join(TASKS[:2]) + ", , Permit_Well_header, Permit_Well, Permit_Well_end", "tasks_branch_from_to_list": "Permit_Well, Permit_Well, No, No",
     "re_No": "x", "header_list": "Quad, Buyer"}
).plan


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [report(rng) for _ in range(150)] + ["", "\n", "\f", "\f\f\n\f", "x", "a\n\n\n", "\f\n\fa\nb\nc\n\fd", "a\n" * 30, "\n\n\r\na\r\n\r\nb"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id bigint, value string")
    frame.write.parquet(folder := f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/random_docs")
    return spark.read.parquet(folder)


def rows(df):
    return sorted(map(str, (tuple(map(str, r)) for r in df.collect())))


@pytest.mark.parametrize("lines", [1, 2, 7])
def test_lines(docs, lines):
    want = explode_lines(docs)
    got = splits.explode_segments(splits.cut_documents(docs, lines)).select(*want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("plan", [default_plan(), default_plan(layout="pack_left"), ENDING], ids=["default", "packed", "ending"])
@pytest.mark.parametrize("lines, few", [(1, 64), (3, 2)])
def test_stages(docs, plan, lines, few, monkeypatch):
    monkeypatch.setattr(splits, "FAN_IN", few)
    cut = splits.cut_documents(docs, lines)
    columns = ["doc_id", "stage", "first_line", "last_line", "n_lines"]
    assert rows(splits.stage_positions(cut, plan).select(columns)) == rows(stage_positions(docs, plan).select(columns))
    want = diagnostics(docs, plan)
    got = rows(splits.diagnostics(cut, plan).select(want.columns))
    assert got == rows(want) and len(got) > 200
    if plan.sticky is not None:
        assert rows(splits.production_wide(cut, plan)) == rows(production_wide(docs, plan))


@pytest.mark.parametrize("together", [1, 3])
def test_neighbours_are_read_as_one(docs, together, monkeypatch):
    monkeypatch.setattr(splits, "TOGETHER", together)
    cut = splits.cut_documents(docs, 1)
    lines = cut.count()
    put = splits._together(cut, "doc_id", "value")
    assert put.count() == lines if together == 1 else put.count() < lines / 2
    columns = ["doc_id", "stage", "first_line", "last_line", "n_lines"]
    assert rows(splits.stage_positions(cut).select(columns)) == rows(stage_positions(docs).select(columns))


def test_gaps_repeats_and_long_segments_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(splits, "TOGETHER_LENGTH", 16 * 5)
    rows_ = [("a", 0, "x"), ("a", 1, ""), ("a", 2, "too long"), ("a", 3, "y"), ("b", 0, "x"), ("b", 0, "y"), ("b", 2, "z"),
             ("c", 15, "p"), ("c", 16, "q"), ("c", 17, ""), ("d", None, "n"), ("e", 1, None), (None, 4, "r"), (None, 5, "s")]
    put = splits._together(spark.createDataFrame(rows_, "doc_id string, segment bigint, value string"), "doc_id", "value")
    # the long one leaves a gap between its neighbours
    apart = [r for r in rows_ if r[0] in ("a", "b", "d", "e")]
    want = [*apart, ("c", 15, "p"), ("c", 16, "q\n"), (None, 4, "r\ns")]
    assert rows(put) == sorted(str(tuple(map(str, r))) for r in want)


def test_borders_by_shuffle(docs, monkeypatch):
    monkeypatch.setattr(splits, "BROADCAST_BYTES", -1)
    want = explode_lines(docs)
    assert rows(splits.explode_segments(splits.cut_documents(docs, 2)).select(*want.columns)) == rows(want)


def test_files_in_splits(spark, tmp_path):
    """Files of many splits, with lines longer than a segment and with one that cannot be decoded."""
    rng = random.Random(12)
    texts = {n: "\n".join(report(rng) for _ in range(60)) for n in "ab"}
    texts["b"] = texts["b"].replace("\n", "\n" + "é" * 3000 + "\n", 2)
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    at = texts["a"].index("\n", 20_000)
    (tmp_path / "c.txt").write_bytes(texts["a"][:at].encode() + b"\n\xff\n" + texts["a"][at:].encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    whole = read_reports(spark, str(tmp_path), "*.txt").drop("bad_line")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parts = read_segments(spark, str(tmp_path), "*.txt", size=500)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts.groupBy("doc_id").count().agg({"count": "min"}).first()[0] > 20
    want = explode_lines(whole)
    assert rows(splits.explode_segments(parts).select(*want.columns)) == rows(want)
    assert rows(splits.production_wide(parts)) == rows(production_wide(whole))


def test_nothing(docs):
    none = splits.cut_documents(docs.limit(0), 1)
    assert splits.explode_segments(none).count() == 0
    assert splits.stage_positions(none).count() == 0 and splits.diagnostics(none).count() == 0


def test_segments_do_not_split_their_document_again(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None)], "doc_id bigint, value string")
    cut = splits.cut_documents(docs, 2)
    assert sorted(map(tuple, cut.collect())) == [(1, 0, "a\nb"), (1, 1, "c"), (2, 0, "")]
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_equal_lines_are_stepped_once(monkeypatch):
    machine, steps = splits._Machine(default_plan(layout="pack_left")), []
    step = splits._Machine.step
    monkeypatch.setattr(splits._Machine, "step", lambda self, *a: steps.append(a) or step(self, *a))
    rng = random.Random(3)
    n = machine.n
    for feeds in (0, 1):
        codes = [rng.choice([0, 1 << 3 | 1 << n + 3, 1 << n - 1 | 1 << 2 * n - 1, feeds << 2 * n]) for _ in range(3000)]
        lines = list(machine.walk(codes, [0, 0], True, False))
        ends = machine.map(iter(lines))
        for at, state in enumerate(machine.numbers):
            for _, line in lines:
                state = step(machine, state, *line)[0]
            assert machine.numbers[state] == ends[at]
    assert 0 < len(steps) < 200 * len(machine.numbers)
