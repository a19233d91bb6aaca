"""Readers: report texts, option lists, stored pages, the landing folder."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlake.operators.lines import cut_at_bad_bytes
from reportlake.operators.numbering import numbered
from reportlake.operators.splits import SEGMENT
from reportlake.session import shared_folder

#: Bytes of text of one segment of a file, unless a line is longer.
SEGMENT_BYTES = 1 << 20


def read_reports(
    spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = True
) -> DataFrame:
    """``raw_docs(doc_id, value, bad_line)``: one row per text file, its path as the key.

    A file is read up to its first undecodable line, whose number is ``bad_line``.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    docs = reader.text(path, wholetext=True)
    return cut_at_bad_bytes(docs.select(F.col("_metadata.file_path").alias("doc_id"), "value"))


def read_segments(
    spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = True, size: int = SEGMENT_BYTES
) -> DataFrame:
    """``(doc_id, segment, value)``: files of any length as rows of whole lines, for ``operators.splits``.

    Files are read in splits, however large; lines go on in the split they begin in. The rows are stored, for
    splits may fall differently when a file is read again. A file is read up to its first undecodable line.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary")
    )

    def pack(batches):
        place, texts, held, n = None, [], 0, 0

        def row():
            values = [[place[0]], [place[1] + n], [b"\n".join(texts)]]
            return pa.RecordBatch.from_arrays(list(map(pa.array, values, (pa.string(), pa.int64(), pa.binary()))), ["doc_id", SEGMENT, "value"])

        for batch in batches:
            for doc, block, text in zip(*[c.to_pylist() for c in batch.columns]):
                if place != (doc, block) or held + len(text) > size:
                    if texts:
                        yield row()
                    # a split has fewer segments than bytes, so these numbers follow each other
                    n = n + 1 if place == (doc, block) else 0
                    place, texts, held = (doc, block), [], 0
                texts.append(text)
                held += len(text) + 1
        if texts:
            yield row()

    packed = lines.mapInArrow(pack, f"doc_id string, {SEGMENT} bigint, value binary")
    folder = f"{shared_folder(spark)}/segments"
    packed.write.parquet(folder)
    stored = spark.read.parquet(folder).withColumn("value", F.col("value").cast("string"))
    ends = stored.where(~F.is_valid_utf8("value")).groupBy(F.col("doc_id").alias("ended")).agg(F.min(SEGMENT).alias("end"))
    met = stored.join(ends, F.col("doc_id") == F.col("ended"), "left").where(f"end IS NULL OR {SEGMENT} <= end")
    return cut_at_bad_bytes(met.select("doc_id", SEGMENT, "value"), bad="bad").drop("bad")


def read_raw_reports(
    spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = True
) -> DataFrame:
    """The same with undecoded bytes, for ``lines.split_undecodable``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("value"))


def read_options_json(spark: SparkSession, path: str) -> DataFrame:
    """``(n, option)`` from files that each hold one JSON array of strings, in order of their names."""
    files = spark.read.text(path, wholetext=True)
    items = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>").alias("items"))
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = items.select("file", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).alias("start"))
    rows = items.select("file", F.posexplode("items").alias("pos", "option")).join(starts, "file")
    return rows.select((F.col("start") + F.col("pos") + 1).alias("n"), "option")


def read_options_list(spark: SparkSession, path: str) -> DataFrame:
    """``(n, option)`` from lists with a header line and one value per line, file after file by name.

    Commas belong to the value, and only the line feed ends it.  Lines are read
    apart, not files, so a list may be of any length.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("option"),
    )
    placed = numbered(lines, ["file"], ["block", "at"], "place")
    # one row per file; the first line of each is its header
    sizes = placed.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    rows = placed.where("place > 1").join(starts, "file")
    return rows.select((F.col("start") + F.col("place") - 1).alias("n"), "option")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_landing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, length, modificationTime)``; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", "length", "modificationTime")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)
