"""Incremental ingest of landed reports.

A document is one row and is parsed within that row, so the batch extraction
runs on a stream as it is: no state, no watermark, nothing kept between batches.
The checkpoint remembers which files were read; a file sink writes every batch
exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportlake.operators.extract import production_wide
from reportlake.operators.lines import cut_at_bad_bytes
from reportlake.plans.grammar import ReportPlan, default_plan

DOCS_SCHEMA = "doc_id string, value string"


def stream_reports(
    spark: SparkSession, path: str, pattern: str = "*.txt", files_per_batch: int | None = None
) -> DataFrame:
    """Text files as documents.  Writers rename a finished file to the pattern, so
    partial ones (``.part``) are never read."""
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    docs = reader.load(path)
    return cut_at_bad_bytes(docs.select(F.col("_metadata.file_path").alias("doc_id"), "value"))


def stream_documents(spark: SparkSession, path: str, schema: str = DOCS_SCHEMA) -> DataFrame:
    """Documents landed as parquet rows."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(
    docs: DataFrame,
    out: str,
    checkpoint: str,
    plan: ReportPlan | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Parse a stream of documents into a parquet table."""
    rows = production_wide(docs, plan or default_plan(), position=True)
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingest_new(
    docs: DataFrame,
    processed: str,
    out: str,
    checkpoint: str,
    key: str = "doc_id",
    plan: ReportPlan | None = None,
) -> StreamingQuery:
    """The same, leaving out documents whose key another job already processed.

    A batch writes under its own number, so one that is run again replaces
    itself instead of doubling rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.parquet(processed).select(key)
        # of the processed keys only those of this batch take part
        seen = seen.join(batch.select(key), key, "left_semi")
        fresh = batch.join(seen, key, "left_anti")
        rows = production_wide(fresh, plan or default_plan(), position=True)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
