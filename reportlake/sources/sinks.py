"""Writers: the report table as CSV, option lists, diagnostics; output names."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import count
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions.text import fill_placeholders, stem

DEFAULT_EXTENSION = ".csv"


def csv_ready(rows: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Exactly these columns in this order; extra ones dropped, missing ones empty."""
    have = set(rows.columns)
    return rows.select(
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
            for c in columns
        ]
    )


def write_csv(
    rows: DataFrame,
    columns: list[str] | tuple[str, ...],
    path: str,
    mode: str = "errorifexists",
    order_by: list[str] | None = None,
    single_file: bool = False,
    compression: str | None = None,
) -> None:
    """CSV with a header line in every file.  ``single_file`` is for small outputs.

    Every row of a document repeats its lists, so a large report takes far less room with ``compression="gzip"``.
    """
    ordered = rows.orderBy(*order_by) if order_by else rows
    out = csv_ready(ordered, columns)
    if single_file:
        out = out.coalesce(1)
    # An output without rows still has its header line.
    writer = out.write.mode(mode).option("header", True).option("emptyValue", "").option("escape", '"')
    # Spaces and form feeds at the ends of a value belong to it.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def output_name(
    docs: DataFrame, template: str = "<File_in>.csv", key: str = "doc_id", order: Column | None = None
) -> str:
    """Output name after the first input: its stem and ``+``; ``.csv`` when no extension is given."""
    first = docs.agg(F.min_by(F.col(key), F.col(key) if order is None else order).alias("first"))
    name = fill_placeholders(
        F.lit(template), {"File_in": F.concat(stem(F.col("first")), F.lit("+"))}
    )
    (row,) = first.select(name.alias("name")).collect()
    head, dot, _ = template.rpartition(".")
    has_extension = bool(dot) and bool(head.strip("./")) and "/" not in template[len(head):]
    return row["name"] if has_extension else row["name"] + DEFAULT_EXTENSION


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes under a path, or None when there is nothing."""
    target, files = _file_system(spark, path)
    return files.getContentSummary(target).getLength() if files.exists(target) else None


def _candidates(path: str) -> Iterator[str]:
    """The path itself, then with ``_(1)``, ``_(2)`` ... before its extension."""
    folder, slash, name = path.rpartition("/")
    head, dot, tail = name.rpartition(".")
    if not head.strip("."):
        head, dot, tail = name, "", ""
    yield path
    yield from (f"{folder}{slash}{head}_({n}){dot}{tail}" for n in count(1))


def free_output(spark: SparkSession, path: str, min_size_to_overwrite: int = 0) -> tuple[str, str]:
    """Path and write mode that never destroy an output worth keeping.

    An output smaller than the limit is overwritten; otherwise ``_(N)`` is put
    before the extension, with the first N that is free.  Another writer may take
    the name before it is used; ``claim_output`` keeps it.
    """
    for candidate in _candidates(path):
        size = _size(spark, candidate)
        if size is None:
            return candidate, "errorifexists"
        if candidate == path and size < min_size_to_overwrite:
            return candidate, "overwrite"


def _beside(path: str, mark: str) -> str:
    """A hidden neighbour of an output, which readers pass over."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}_{name}.{mark}"


def _created(spark: SparkSession, path: str) -> bool:
    """Was an empty file made here that did not exist, in one step?"""
    target, files = _file_system(spark, path)
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":  # there Hadoop looks first and creates then
        local = target.toUri().getPath()
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(target, False).close()
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    return True


def claim_output(spark: SparkSession, path: str, min_size_to_overwrite: int = 0) -> tuple[str, str]:
    """``free_output`` with the name kept from other claims until ``release_output``.

    The claim is a hidden file beside the output.  A name another writer holds counts as used,
    and so does one whose writer died before it could release it.
    """
    for candidate in _candidates(path):
        if not _created(spark, _beside(candidate, "claim")):
            continue
        # looked at under the claim: an earlier holder may have written meanwhile
        size = _size(spark, candidate)
        if size is None:
            return candidate, "errorifexists"
        if candidate == path and size < min_size_to_overwrite:
            return candidate, "overwrite"
        release_output(spark, candidate)


def release_output(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, _beside(path, "claim"))
    files.delete(target, False)


def write_claimed(
    rows: DataFrame, columns: list[str] | tuple[str, ...], path: str, min_size_to_overwrite: int = 0, **options
) -> str:
    """Writes the CSV under a free name and returns it, whatever other writers do at the same time.

    The rows are written beside the output and take its name in one rename, so an output is never
    seen in part, and a write that fails leaves the earlier output as it was.
    """
    spark = rows.sparkSession
    name, mode = claim_output(spark, path, min_size_to_overwrite)
    part = _beside(name, f"part-{uuid4().hex}")
    target, files = _file_system(spark, name)
    made, _ = _file_system(spark, part)
    try:
        write_csv(rows, columns, part, **options)
        if mode == "overwrite":
            files.delete(target, True)
        if not files.rename(made, target):
            raise OSError(f"no output could be placed at {name}")
    finally:
        files.delete(made, True)
        release_output(spark, name)
    return name


def write_options(options: DataFrame, path: str, column: str = "option", header: str | None = None) -> None:
    """The list as text, one option per line, sorted over all files; each begins with the header, if any."""
    ordered = _by_range(options.select(F.col(column).cast("string").alias("value")))
    if header is not None:

        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = [header]
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"value": pa.array(first + batch.column(0).to_pylist(), pa.string())})
                first = []

        ordered = ordered.mapInArrow(headed, "value string")
    ordered.write.mode("errorifexists").text(path)


def _by_range(options: DataFrame) -> DataFrame:
    """Sorted over all partitions, each holding a stretch of the values."""
    return options.repartitionByRange("value").sortWithinPartitions("value")


def write_options_json(options: DataFrame, path: str, column: str = "option", single_file: bool = False) -> None:
    """The sorted list as JSON: every file one array, an item per line, file after file in order.

    Each task brackets its own stretch of the list.  ``single_file`` is for small lists.
    """
    items = F.regexp_replace(F.to_json(F.array(F.col("value"))), r"^\[|\]$", "")
    ordered = _by_range(options.select(F.col(column).cast("string").alias("value")))
    if single_file:
        ordered = ordered.coalesce(1).sortWithinPartitions("value")

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lines = ([] if held is None else [held]) + batch.column(0).to_pylist()
            if not lines:
                continue
            if held is None:
                yield pa.RecordBatch.from_pydict({"value": pa.array(["["], pa.string())})
            held = lines.pop()
            yield pa.RecordBatch.from_pydict({"value": pa.array([x + "," for x in lines], pa.string())})
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": pa.array([held, "]"], pa.string())})

    ordered.select(items.alias("value")).mapInArrow(bracketed, "value string").write.mode("errorifexists").text(path)


def write_diagnostics(events: DataFrame, path: str, mode: str = "append") -> None:
    events.write.mode(mode).partitionBy("kind").parquet(path)
