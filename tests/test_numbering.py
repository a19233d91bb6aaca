from __future__ import annotations

import random

from pyspark.sql import functions as F

from reportlake.operators import worklist
from reportlake.operators.numbering import _sorted, enumerated, numbered, running_total


def test_sparse_ids_of_one_hot_key(spark):
    """Random 64-bit ids: no part of the sorted rows holds more than a share of the key."""
    rng = random.Random(1)
    ids = list({rng.randrange(-(2**63), 2**63) for _ in range(20_000)})
    df = spark.createDataFrame([("hot", i) for i in ids] + [("cold", 5), (None, 7), (None, None)], "k string, id bigint")
    got = {(r.k, r.id): r.n for r in numbered(df.repartition(6), ["k"], "id", "n").collect()}
    assert [got["hot", i] for i in sorted(ids)] == list(range(1, len(ids) + 1))
    assert (got["cold", 5], got[None, None], got[None, 7]) == (1, 1, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in _sorted(df, ["k", "id"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 6 and max(parts) < 2 * sum(parts) / len(parts)


def test_equal_rows_of_one_key(spark):
    """Rows that nothing tells apart lie in several parts, and each number is given once."""
    df = spark.range(50_000).repartition(6).selectExpr("'hot' AS k", "7 AS at", "'same' AS said")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in _sorted(df, ["k", "at"]).groupBy("_part").count().collect()]
        got = numbered(df, ["k"], "at", "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 5 and max(parts) < 20_000
    assert tuple(got) == (1, 50_000, 50_000)


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i * 977 % 5003, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = {(r.k, r.at): r.t for r in running_total(df, ["k"], "at", F.col("v"), "t").collect()}
    for key in "ab":
        total = 0
        for _, at, v in sorted(r for r in rows if r[0] == key):
            total += v
            assert got[key, at] == total


def test_numbers_with_nulls_and_nothing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "option string")
    assert {r.option: r.n for r in enumerated(df, "option").collect()} == {None: 1, "a": 2, "b": 3, "c": 4}
    assert enumerated(df.limit(0), "option").count() == 0


def test_hot_name_with_sparse_numbers(spark):
    rng = random.Random(3)
    asked = rng.sample(range(2**62), 3000)
    requests = spark.createDataFrame([(n, "name", ".xls") for n in asked], "n bigint, option string, ext string")
    taken = {0, 3, 4, 10**12, *rng.sample(range(5000), 700)}
    existing = spark.createDataFrame([(f"name_({i}).xls" if i else "name.xls",) for i in taken], "file_name string")
    got = {r.n: r.number for r in worklist.plan_file_names(requests, existing).collect()}
    free = (i for i in range(10**6) if i not in taken)
    assert [got[n] for n in sorted(asked)] == [next(free) for _ in asked]
