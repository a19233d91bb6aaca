from __future__ import annotations

import gzip
import hashlib
from collections import defaultdict

import pytest

from reportlake.llm import warc
from reportlake.session import shared_folder

LONG = "ü" * 600
PAGES = [
    (1, "http://a/1", LONG), (7, "http://a/7", LONG), (3, None, LONG), (None, "http://a/n", LONG), (7, "http://a/7", LONG),
    (4, "http://b\r\nX: y", "WARC/1.1\r\n\r\n" * 100), (5, "u", "WARC/1.1\r\n\r\n" * 100), (9, "u", "short"), (10, "u", "short"),
    (11, "u", None), (12, "u", ""), (13, "u", "x" * 999), (14, "u", "x" * 999), (15, "u", "y" * 1000), (16, "u", "y" * 1000),
    (17, "u", "z" * 3_000_000), (18, "u", "line\r\n\r\n\x00\f" * 300),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS id", "'d' AS digest", "'p' AS payload")


def written(spark, pages):
    folder = shared_folder(spark)
    warc.archive(pages, f"{folder}/all", date="2020-01-01T00:00:00Z")
    warc.deduplicate(spark, f"{folder}/all", f"{folder}/some")
    return folder


def test_round_trip(spark, pages):
    folder = written(spark, pages)
    rows = warc.read_archives(spark, f"{folder}/all", payload=True).collect()
    have = sorted((r["id"] or "", r["payload"], r["payload_bytes"], r["actual"]) for r in rows)
    assert have == sorted((str(i) if i else "", h or "", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in PAGES)
    assert all(r["actual"] == r["digest"] and r["record_type"] == "response" and r["date"] == "2020-01-01T00:00:00Z" for r in rows)
    assert len({r["record_id"] for r in rows}) == len(PAGES)
    assert {r["uri"] for r in rows if r["id"] == "4"} == {"http://b%0D%0AX: y"}


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_revisits(spark, pages, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    folder = written(spark, pages)
    rows = warc.resolved(warc.read_archives(spark, f"{folder}/some", payload=True)).collect()
    by = defaultdict(list)
    for i, _, html in PAGES:
        by[html or ""].append(i)
    assert len(rows) == len(PAGES)
    for r in rows:
        page = int(r["id"]) if r["id"] else None
        html = next(h or "" for i, _, h in PAGES if i == page)
        assert (r["payload_bytes"], r["actual"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        if len(html.encode()) < 1000:
            assert r["record_type"] == "response"
        else:
            largest = max(x or -1 for x in by[html])
            if r["record_type"] == "revisit":
                assert r["refers_id"] == str(largest) and r["payload"] is None
            else:
                assert page == largest and r["payload"] == html and r["refers_to"] is None
    kinds = [r["id"] for r in rows if r["record_type"] == "response" and r["id"] == "7"]
    assert len(kinds) == 1  # of two equal rows one is the original


def test_again(spark, pages):
    """Archives with revisits can be taken through once more and stay what they are."""
    folder = written(spark, pages)
    warc.deduplicate(spark, f"{folder}/some", f"{folder}/again")
    read = lambda name: sorted(map(str, warc.read_archives(spark, f"{folder}/{name}", payload=True).collect()))
    assert read("some") == read("again")


def test_files_are_bounded(spark):
    """Records of unlike length lie in files of their own, none with more than its share."""
    rows = [(i, "u", ("a" if i % 50 else "long " * 3000) * (1 + i % 3)) for i in range(1000)]
    folder = shared_folder(spark)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(1)
    records = pages.selectExpr("string(page_id) AS record_id", "'response' AS record_type", "string(page_id) AS id", "url AS uri", "'d' AS date",
                               "'x' AS digest", "string(null) AS refers_to", "string(null) AS refers_uri", "string(null) AS refers_date", "html AS payload")
    warc.write_archives(records, folder, file_bytes=100_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder).collect()
    sizes = [len(gzip.decompress(bytes(f["content"]))) for f in files]
    assert len(files) > 5 and max(sizes) < warc.SPREAD * 100_000
    assert warc.read_archives(spark, folder).count() == 1000


def test_damaged_archive(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_empty(spark, pages):
    folder = written(spark, pages.limit(0))
    assert warc.resolved(warc.read_archives(spark, f"{folder}/some")).count() == 0
