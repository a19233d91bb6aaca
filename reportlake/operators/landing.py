"""The landing folder: state of each file, newest file per option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import base_name, extension

# Size limits in bytes and the mark of an unfinished download.
READY_ABOVE = 10
STALE_ABOVE = 20
PARTIAL = ".part"


def leftover_state(length: Column) -> Column:
    """Files found before a download starts: kept aside when they hold something."""
    return F.when(length > STALE_ABOVE, F.lit("stale")).otherwise(F.lit("discard"))


def landed_state(path: Column, length: Column) -> Column:
    """Files that appeared since."""
    return (
        F.when(extension(path) == PARTIAL, F.lit("partial"))
        .when(length <= READY_ABOVE, F.lit("not_ready"))
        .otherwise(F.lit("ready"))
    )


def landing_state(landing: DataFrame, started: Column) -> DataFrame:
    """Each file with its state; nothing is moved or removed.

    ``moved_as`` is the name a stale file would be kept under.
    """
    before = F.col("modificationTime") < started
    state = F.when(before, leftover_state(F.col("length"))).otherwise(
        landed_state(F.col("path"), F.col("length"))
    )
    return landing.withColumn("state", state).withColumn(
        "moved_as", F.when(F.col("state") == "stale", F.concat(F.lit("_"), base_name(F.col("path"))))
    )


def newest_file(landing: DataFrame, keys: list[str]) -> DataFrame:
    """The file modified last; of several with the same time, the greatest name."""
    newest = F.max_by("path", F.struct("modificationTime", "path"))
    return landing.groupBy(*keys).agg(
        newest.alias("path"), F.max("modificationTime").alias("modificationTime")
    )


def new_files(listed: DataFrame, seen: DataFrame, column: str = "path") -> DataFrame:
    """Files of the folder that were not there before."""
    return listed.join(seen.select(column).distinct(), column, "left_anti")
