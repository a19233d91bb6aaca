"""What several operators share: stored intermediates, words, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.session import shared_folder

#: A group with more than one row in HOT_SHARE of all rows counts as hot; there are fewer than HOT_SHARE.
HOT_SHARE = 1000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: later steps start from files."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Words of 0-9, a-z and characters beyond ASCII; only A-Z are lower-cased. Null has none."""
    return F.array_remove(F.split(lowered(text), NO_WORD), "")


def flags(numbers: Column) -> Column:
    """Sorted numbers as bytes, 1 at each of them and 0 between; a byte is found by its place, however many there are."""
    gap = F.transform(
        numbers,
        lambda n, j: F.concat(F.repeat(F.lit("0"), n - F.coalesce(F.get(numbers, j - 1), F.lit(-1)) - 1), F.lit("1")),
    )
    return F.array_join(gap, "").cast("binary")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, where a group may hold any share of the rows.

    ``size`` is the group's row count among ``total`` rows. Groups above a fixed share of all rows
    are fewer than HOT_SHARE whatever the input, so they are broadcast and their rows never move;
    no other key can fill more than that share of a shuffle.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(few, keys, "left_anti").join(cold, keys)
    )
