from __future__ import annotations

import csv
import json
import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from random_reports import report
from reportlake.operators.diagnostics import at_least, diagnostics
from reportlake.operators.extract import production_wide
from reportlake.operators.worklist import distinct_options
from reportlake.plans.grammar import default_plan
from reportlake.sources import readers, sinks
from reportlake.streaming.ingest import ingest, ingest_new, stream_reports


def write_reports(folder: Path, seeds) -> dict[str, str]:
    folder.mkdir(parents=True, exist_ok=True)
    texts = {}
    for i in seeds:
        texts[f"r{i:03d}.txt"] = report(random.Random(i))
        (folder / f"r{i:03d}.txt").write_bytes(texts[f"r{i:03d}.txt"].encode())
    return texts


def test_reports_to_csv(spark, tmp_path):
    write_reports(tmp_path / "in", range(20))
    write_reports(tmp_path / "in" / "deep", range(20, 30))
    (tmp_path / "in" / "other.log").write_text("no report")
    docs = readers.read_reports(spark, str(tmp_path / "in"), "*.txt")
    assert docs.count() == 30
    assert readers.read_reports(spark, str(tmp_path / "in"), "*.txt", recursive=False).count() == 20
    both = readers.union_sources([docs, docs])
    assert both.count() == 60
    plan = default_plan()
    rows = production_wide(docs, plan, position=True)
    name = sinks.output_name(docs, "<File_in>")
    assert name == "r020+.csv"
    assert sinks.output_name(docs, "x/<File_in>.txt") == "x/r020+.txt"
    out, mode = sinks.free_output(spark, str(tmp_path / name))
    sinks.write_csv(rows, plan.columns, out, mode, order_by=["doc_id", "line_no"], single_file=True)
    again, mode = sinks.free_output(spark, str(tmp_path / name))
    assert again == str(tmp_path / "r020+_(1).csv") and mode == "errorifexists"
    assert sinks.free_output(spark, str(tmp_path / name), 10**9) == (str(tmp_path / name), "overwrite")
    (part,) = Path(out).glob("part-*.csv")
    written = list(csv.DictReader(part.open(newline="")))
    assert list(written[0]) == list(plan.columns)
    kept = rows.orderBy("doc_id", "line_no").collect()
    assert [[w[c] for c in plan.columns] for w in written] == [
        ["" if r[c] is None else r[c] for c in plan.columns] for r in kept
    ]


def test_csv_has_a_header_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "a string")
    sinks.write_csv(empty, ["a", "b"], str(tmp_path / "o"), single_file=True)
    (part,) = (tmp_path / "o").glob("part-*.csv")
    assert part.read_text().strip() == "a,b"


def test_raw_reports(spark, tmp_path):
    write_reports(tmp_path / "in", range(3))
    raw = readers.read_raw_reports(spark, str(tmp_path / "in"))
    assert dict(raw.dtypes) == {"doc_id": "string", "value": "binary"} and raw.count() == 3


def test_option_lists(spark, tmp_path):
    options = ["b, c", "a", 'q "x"', "é", "a"]
    df = spark.createDataFrame([(o,) for o in options], "option string")
    unique = distinct_options(df)
    sinks.write_options_json(unique, str(tmp_path / "json"))
    (part,) = (tmp_path / "json").glob("part-*")
    assert json.loads(part.read_text()) == sorted(set(options))
    back = readers.read_options_json(spark, str(part)).orderBy("n").collect()
    assert [(r.n, r.option) for r in back] == list(enumerate(sorted(set(options)), 1))
    sinks.write_options(unique, str(tmp_path / "text"))
    parts = sorted((tmp_path / "text").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == sorted(set(options))
    (tmp_path / "list.csv").write_bytes(b"API\n12,3\r\n\nlast")
    listed = readers.read_options_list(spark, str(tmp_path / "list.csv")).orderBy("n").collect()
    assert [(r.n, r.option) for r in listed] == [(1, "12,3\r"), (2, ""), (3, "last")]


def test_landing_reads_no_content(spark, tmp_path):
    write_reports(tmp_path / "in", range(2))
    files = readers.read_landing(spark, str(tmp_path / "in"))
    assert files.columns == ["path", "length", "modificationTime"] and files.count() == 2
    assert "content:" not in files._jdf.queryExecution().executedPlan().toString()


def test_diagnostics_are_kept_by_kind(spark, tmp_path):
    texts = {i: report(random.Random(i)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, value string")
    events = diagnostics(docs, default_plan())
    sinks.write_diagnostics(events, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == events.count()
    assert at_least(back, "WARNING").where("kind = 'masked_cell'").count() == 0


def test_stream_reads_each_report_once(spark, tmp_path):
    landing, out, mark = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "mark")
    plan = default_plan()

    def run():
        ingest(stream_reports(spark, str(landing), files_per_batch=4), out, mark, plan).awaitTermination()

    write_reports(landing, range(10))
    (landing / "late.txt.part").write_text("partial")
    run()
    write_reports(landing, range(10, 16))
    time.sleep(0.1)
    run()
    run()
    columns = ["doc_id", "line_no", *plan.columns]
    got = sorted(map(str, spark.read.parquet(out).select(*columns).collect()))
    docs = readers.read_reports(spark, str(landing), "*.txt")
    expected = sorted(map(str, production_wide(docs, plan, position=True).select(*columns).collect()))
    assert got == expected and got


def test_stream_leaves_out_processed_reports(spark, tmp_path):
    landing = tmp_path / "landing"
    write_reports(landing, range(30))
    docs = readers.read_reports(spark, str(landing), "*.txt")
    done = docs.where(F.col("doc_id").rlike("r00[0-9]")).select("doc_id")
    done.write.parquet(str(tmp_path / "done"))
    query = ingest_new(
        stream_reports(spark, str(landing)), str(tmp_path / "done"), str(tmp_path / "out"), str(tmp_path / "mark")
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    fresh = docs.join(done, "doc_id", "left_anti")
    assert rows.count() == production_wide(fresh).count() > 0


def test_racing_writers_get_names_of_their_own(spark, tmp_path):
    path = f"file:{tmp_path}/out/report.csv"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: sinks.claim_output(spark, path), range(16)))
    names = {f"file:{tmp_path}/out/report{n}.csv" for n in ("", *(f"_({i})" for i in range(1, 16)))}
    assert {p for p, _ in got} == names and {m for _, m in got} == {"errorifexists"}
    for name in names:
        sinks.release_output(spark, name)
    frames = [spark.range(50).selectExpr(f"{k} AS who", "id") for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        written = list(pool.map(lambda f: sinks.write_claimed(f, ["who", "id"], path), frames))
    assert len(set(written)) == 4 and path in written
    for k, name in enumerate(written):
        rows = spark.read.option("header", True).csv(name).collect()
        assert len(rows) == 50 and {r["who"] for r in rows} == {str(k)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(("_", "._"))]


def test_a_failed_write_keeps_the_earlier_output(spark, tmp_path):
    path = f"file:{tmp_path}/report.csv"
    rows = spark.range(3).selectExpr("id")
    assert sinks.write_claimed(rows, ["id"], path) == path
    broken = spark.range(3).selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception, match="no"):
        sinks.write_claimed(broken, ["id"], path, min_size_to_overwrite=1 << 20)
    assert spark.read.option("header", True).csv(path).count() == 3
    more = spark.range(5).selectExpr("id")
    assert sinks.write_claimed(more, ["id"], path, min_size_to_overwrite=1 << 20) == path
    assert spark.read.option("header", True).csv(path).count() == 5
    assert sinks.write_claimed(rows, ["id"], path) == f"file:{tmp_path}/report_(1).csv"
