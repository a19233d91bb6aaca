"""File names for requests in batches, against asking for one name after the other."""

from __future__ import annotations

import random

import pytest

from reportlake.operators import names


def one_by_one(asked: list[str], files: set[str]) -> list[str]:
    out = []
    for name in asked:
        n, free = 0, f"{name}.xls"
        while free in files:
            n += 1
            free = f"{name}_({n}).xls"
        files.add(free)
        out.append(free)
    return out


def plan(spark, batches, files, book):
    names.open_book(spark.createDataFrame([(f,) for f in files], "file_name string"), book)
    n = 0
    for i, batch in enumerate(batches, 1):
        rows = [(n + j, name, ".xls") for j, name in enumerate(batch)]
        n += len(batch)
        names.plan_batch(spark.createDataFrame(rows, "n bigint, option string, ext string").repartition(3), book, i)
    return {r["n"]: r["file_name"] for r in names.planned(spark, book).collect()}


def test_batches_equal_one_after_the_other(spark, tmp_path):
    """Few names, so that they compete; one request of a numbered name in a batch, before the shorter name is asked for."""
    rng = random.Random(5)
    files = {"a.xls", "a_(1).xls", "a_(4).xls", "b_(2).xls", "a_(2)_(1).xls", "c.txt", "d_(0).xls", ".xls", "e_(007).xls"}
    for turn in range(3):
        batches = []
        for _ in range(3):
            batch = [rng.choice("abcde") for _ in range(rng.randrange(12))]
            batches.append([rng.choice(["a_(2)", "a_(9)", "b_(1)", "a_(2)_(1)", "b_(2)"]), *batch])
        want = one_by_one([x for b in batches for x in b], set(files))
        got = plan(spark, batches, files, str(tmp_path / f"book{turn}"))
        assert [got[i] for i in range(len(want))] == want


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    book = str(tmp_path / "book")
    first = plan(spark, [["a", "a"], ["a"], ["a", "b"]], set(), book)
    again = spark.createDataFrame([(2, "a", ".xls")], "n bigint, option string, ext string")
    assert [r["file_name"] for r in names.plan_batch(again, book, 2).collect()] == ["a_(2).xls"]
    assert {r["n"]: r["file_name"] for r in names.planned(spark, book).collect()} == first


def test_runs_not_names_are_kept(spark, tmp_path):
    book = str(tmp_path / "book")
    files = ["hot.xls", *[f"hot_({i}).xls" for i in range(1, 5000) if i != 777]]
    got = plan(spark, [["hot"] * 3000, [], ["hot"] * 10], files, book)
    assert got[0] == "hot_(777).xls" and got[3009] == f"hot_({5000 + 3008}).xls" and len(set(got.values())) == 3010
    runs = spark.read.parquet(f"{book}/runs").collect()
    assert sorted((r["batch"], r["first"], r["last"]) for r in runs) == [(0, 0, 776), (0, 778, 4999), (1, 0, 7998), (3, 0, 8008)]


@pytest.mark.parametrize("option, ext", [(None, ".xls"), ("", ""), ("x/y", None)])
def test_odd_requests(spark, tmp_path, option, ext):
    book = str(tmp_path / "book")
    names.open_book(spark.createDataFrame([(None,)], "file_name string"), book)
    rows = spark.createDataFrame([(1, option, ext), (2, option, ext)], "n bigint, option string, ext string")
    got = [r["file_name"] for r in names.plan_batch(rows, book, 1).orderBy("n").collect()]
    assert got == {None: [], "": ["", "_(1)"], "x/y": ["x_y", "x_y_(1)"]}[option]
