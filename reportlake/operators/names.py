"""Free file names for requests that come in batches.

What is taken is kept as runs of numbers per name, not as names: ``first`` to ``last`` of the family
``stem``, ``ext``. A file is kept once, ``a_(2).xls`` as number 2 of ``a``, ``.xls`` and a plain name as number 0
of its own, so a list of a million files of one name that has no gaps is one row. Each batch writes the runs of
the names it touched; the last batch that wrote a name holds for it. A batch that is run again
replaces what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportlake.functions.text import extension, safe_file_name, stem
from reportlake.operators.numbering import running_total
from reportlake.operators.worklist import _NUMBERED, _name, _numbers

_FAMILY = ["stem", "ext"]
_RUNS = "stem string, ext string, first bigint, last bigint, batch bigint"
_PLAN = "n bigint, option string, number bigint, file_name string, batch bigint"


def _place_of(whole: Column) -> list[Column]:
    """The family a name without its extension is kept under, and its number there."""
    own = ~whole.rlike(_NUMBERED)
    return [
        F.when(own, whole).otherwise(F.regexp_extract(whole, _NUMBERED, 1)).alias("stem"),
        F.when(own, F.lit(0)).otherwise(F.regexp_extract(whole, _NUMBERED, 2).try_cast("bigint")).cast("bigint").alias("first"),
    ]


def _merged(runs: DataFrame) -> DataFrame:
    """Runs that share no number, neighbours made one: those with as many free numbers before them."""
    length = F.col("last") - F.col("first") + 1
    upto = running_total(runs, _FAMILY, "first", length, "_upto")
    free = (F.col("first") - F.col("_upto") + length).alias("_free")
    grouped = upto.select("*", free).groupBy(*_FAMILY, "_free").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return grouped.select(*_FAMILY, "first", "last")


def _folder(book: str, kind: str, batch: int) -> str:
    return f"{book}/{kind}/batch={batch}"


def open_book(existing: DataFrame, book: str, file: str = "file_name") -> None:
    """Begins a book in the folder ``book`` with the files there are; names may repeat."""
    name = F.col(file)
    taken = existing.where(name.isNotNull()).select(stem(name).alias("_whole"), extension(name).alias("ext"))
    taken = taken.select(*_place_of(F.col("_whole")), "ext").distinct().withColumn("last", F.col("first"))
    _merged(taken).write.mode("overwrite").parquet(_folder(book, "runs", 0))


def _held(spark: SparkSession, book: str, families: DataFrame, before: int) -> DataFrame:
    """The runs of the given different families, as they were before a batch."""
    kept = spark.read.schema(_RUNS).parquet(f"{book}/runs").where(F.col("batch") < before).join(families, _FAMILY, "left_semi")
    last = kept.groupBy(*_FAMILY).agg(F.max("batch").alias("batch"))
    return kept.join(last, [*_FAMILY, "batch"], "left_semi").select(*_FAMILY, "first", "last")


def _covered(numbers: DataFrame, runs: DataFrame) -> DataFrame:
    """``(stem, ext, first, taken)``: for different numbers of families, does a run hold them?

    One pass over both in order: a run counts from its begin to behind its end.
    """
    begins = runs.select(*_FAMILY, (F.col("first") * 3).alias("at"), F.lit(1).alias("step"))
    ends = runs.select(*_FAMILY, (F.col("last") * 3 + 2).alias("at"), F.lit(-1).alias("step"))
    asked = numbers.select(*_FAMILY, (F.col("first") * 3 + 1).alias("at"), F.lit(0).alias("step"))
    points = reduce(DataFrame.unionByName, [begins, ends, asked])
    totals = running_total(points, _FAMILY, "at", F.col("step"), "open").where("step = 0")
    return totals.select(*_FAMILY, F.expr("(at - 1) DIV 3").alias("first"), (F.col("open") > 0).alias("taken"))


def plan_batch(requests: DataFrame, book: str, batch: int, option: str = "option", ext: str = "ext", n: str = "n") -> DataFrame:
    """``(n, option, number, file_name)``: a free name for each request of a batch, in the order of ``n``.

    Batches count from 1. Names given in earlier batches, and the files the book began with, are used; inside a
    batch it is as in ``plan_file_names``. Batches in list order so give what the whole list would, except
    that a name like ``a_(2)`` is asked for after an earlier batch gave it away: then it is used, as it would be
    asking one after the other. Null options get no name; a null extension is an empty one.
    """
    spark = requests.sparkSession
    asked = requests.where(F.col(option).isNotNull()).select(
        F.col(n).cast("bigint").alias("_n"), F.col(option).alias("_option"), safe_file_name(F.col(option)).alias("stem"),
        F.coalesce(F.col(ext), F.lit("")).alias("ext"),
    )
    families = asked.select(*_FAMILY).distinct()
    numbered = families.where(F.col("stem").rlike(_NUMBERED))
    shorter = numbered.select(F.col("stem").alias("_whole"), "ext", *_place_of(F.col("stem")))
    wider = families.unionByName(shorter.select(*_FAMILY)).distinct()
    held = _held(spark, book, wider, batch)
    # a plain name that reads as a number of a shorter one is taken if that has the number; else it takes it now
    known = _covered(shorter.select(*_FAMILY, "first"), held.join(shorter.select(*_FAMILY).distinct(), _FAMILY, "left_semi"))
    met = shorter.join(known, [*_FAMILY, "first"])
    zero = F.lit(0).cast("bigint")
    gone = met.where("taken").select(F.col("_whole").alias("stem"), "ext", zero.alias("first"), zero.alias("last"))
    crossing = met.where("NOT taken").select(*_FAMILY, "first", F.col("first").alias("last"))
    used = held.unionByName(gone).unionByName(crossing).join(families, _FAMILY, "left_semi")
    planned = _numbers(asked, used).select(F.col("_n").alias("n"), F.col("_option").alias("option"), "number", _name().alias("file_name"))
    planned.write.mode("overwrite").parquet(_folder(book, "plan", batch))
    given = spark.read.schema(_PLAN).parquet(f"{book}/plan").where(F.col("batch") == batch).drop("batch")
    name = F.col("file_name")
    fresh = given.select(stem(name).alias("_whole"), extension(name).alias("ext")).select(*_place_of(F.col("_whole")), "ext")
    fresh = fresh.withColumn("last", F.col("first"))
    touched = fresh.select(*_FAMILY).distinct()
    runs = _held(spark, book, touched, batch).unionByName(fresh)
    _merged(runs).write.mode("overwrite").parquet(_folder(book, "runs", batch))
    return given


def planned(spark: SparkSession, book: str) -> DataFrame:
    """``(n, option, number, file_name, batch)`` of all batches so far."""
    return spark.read.schema(_PLAN).parquet(f"{book}/plan")


def stream_names(requests: DataFrame, book: str, checkpoint: str) -> StreamingQuery:
    """Plans names for a stream of ``(n, option, ext)``, each micro-batch after those before it."""

    def write(rows: DataFrame, number: int) -> None:
        plan_batch(rows, book, number + 1)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
