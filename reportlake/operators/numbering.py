"""Running totals and numbers that do not put a whole group into one task.

A plain ``row_number`` window sorts each group in one task.  Here the rows are
sorted once over the whole cluster by range and written to the shared folder with
their place; a small table, one row per key and sorted part, tells where each key
begins in each part.  A key that holds most of the rows is spread over as many
parts as its rows fill, whatever its positions look like; rows that are equal in key
and position part where they come from different parts of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import shared_folder

#: monotonically_increasing_id holds the part above so many bits, the place in it below.
_PLACE_BITS = 33


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in order, stored, with ``_part`` (parts follow each other) and ``_place`` in it."""
    spark = df.sparkSession
    # where a row comes from stays the same if its task is run again, unlike its place there
    out = df.withColumn("_tie", F.spark_partition_id()).repartitionByRange(*order, "_tie")
    out = out.drop("_tie").sortWithinPartitions(*order)
    out = out.withColumn("_at", F.monotonically_increasing_id())
    folder = f"{shared_folder(spark)}/sorted"
    out.write.parquet(folder)
    stored = spark.read.schema(out.schema).parquet(folder)
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return stored.select(*df.columns, F.shiftright("_at", _PLACE_BITS).alias("_part"), place.alias("_place"))


def _with_starts(cut: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """``cut`` with the sums over all earlier parts of its key, and ``_first``, its first place in the part.

    The window runs over one row per part of a key.
    """
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), *[c.alias(n) for n, c in sums.items()])
    heads = heads.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), "_first",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
    )
    same = reduce(lambda a, k: a & cut[k].eqNullSafe(F.col(f"_key_{k}")), keys, cut["_part"] == F.col("_of"))
    return cut.join(heads, same)


def running_totals(df: DataFrame, keys: list[str], position: str, amounts: dict[str, Column]) -> DataFrame:
    """Sums up to and including each row, per key, by ``position``: a column for each name of ``amounts``.

    Positions are of any sortable type, without repeats inside a key; a null one comes first.
    """
    own = {n: f"_amount_{i}" for i, n in enumerate(amounts)}
    cut = _sorted(df.withColumns({own[n]: c.cast("bigint") for n, c in amounts.items()}), [*keys, position])
    inside = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_local{c}": F.sum(c).over(inside) for c in own.values()})
    met = _with_starts(local, keys, **{f"_start{c}": F.sum(c) for c in own.values()})
    return met.select(*df.columns, *[(F.col(f"_start{c}") + F.col(f"_local{c}")).alias(n) for n, c in own.items()])


def running_total(df: DataFrame, keys: list[str], position: str, amount: Column, name: str) -> DataFrame:
    """The same for one amount."""
    return running_totals(df, keys, position, {name: amount})


def numbered(df: DataFrame, keys: list[str], position: str | list[str], name: str) -> DataFrame:
    """One-based number of each row inside its key, by ``position``; a null position comes first."""
    order = [position] if isinstance(position, str) else position
    met = _with_starts(_sorted(df, [*keys, *order]), keys, _start=F.count(F.lit(1)))
    return met.select(*df.columns, (F.col("_start") + F.col("_place") - F.col("_first") + 1).alias(name))


def enumerated(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """One-based number of each row in ascending order of a column without repeats, null first."""
    return numbered(df, [], column, name)
