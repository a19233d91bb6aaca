"""Exact dedup by two passes over a Bloom filter.

The first pass hashes every text and counts, in a blocked Bloom filter, which bits are set more than
once. The second pass asks that filter: a row with a bit that nobody else set has no equal and goes
straight to the result; only the rest is shuffled by content and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import attach, stored

#: Bits of one block of the filter, as Spark's bitmap functions have them.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
#: A filter up to this size is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _places(content: Column, rows: int) -> tuple[Column, Column, Column]:
    """Block and two different bits in it."""
    blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    bits = F.xxhash64(content, F.lit("bits"))
    first = F.pmod(bits, F.lit(BLOCK_BITS))
    step = F.pmod(F.shiftrightunsigned(bits, 17), F.lit(BLOCK_BITS - 1)) + 1
    return F.pmod(F.xxhash64(content), F.lit(blocks)), first, (first + step) % BLOCK_BITS


def _marks(rows: DataFrame, content: str, n: int) -> DataFrame:
    block, first, second = _places(F.col(content), n)
    return rows.select(block.alias("__block"), F.explode(F.array(first, second)).alias("__bit"))


def repeated_bits(rows: DataFrame, content: str, n: int) -> DataFrame:
    """Blocks of the filter with the bits that at least two rows set: __block, __bitmap."""
    return (
        _marks(rows, content, n)
        .groupBy("__block", "__bit")
        .count()
        .where("count > 1")
        .groupBy("__block")
        .agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )


def maybe_repeated(rows: DataFrame, blocks: DataFrame, content: str, n: int) -> DataFrame:
    """The rows with __maybe: false only for rows whose content no other row has."""
    block, first, second = _places(F.col(content), n)

    def is_set(bit: Column) -> Column:
        byte = F.substring(F.col("__bitmap"), (bit / 8).cast("int") + 1, F.lit(1))
        value = F.ascii(F.decode(byte, "ISO-8859-1")).cast("long")
        return F.getbit(value, (bit % 8).cast("int")) == 1

    size = max(1, -(-n * BITS_PER_ROW // BLOCK_BITS)) * BLOCK_BITS // 8
    side = F.broadcast(blocks) if size <= max(BROADCAST_BYTES, BLOCK_BITS // 8) else blocks
    return (
        rows.withColumn("__block", block)
        .join(side, "__block", "left")
        .withColumn("__maybe", F.coalesce(is_set(first) & is_set(second), F.lit(False)))
        .drop("__block", "__bitmap")
    )


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__n"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("__sha"),
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: keep_id (of the equal row that stays), group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting white space (``[\\x20\\x09-\\x0D]``); null
    counts as empty, and empty texts are equal to each other. The longest original stays, then the
    smallest id (null first). Of fully repeated rows, id included, exactly one is kept. Only id and
    text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    rows = stored(_hashed(docs, id_col, text_col), "hashes")
    n = rows.count()
    blocks = stored(repeated_bits(rows, "__sha", n), "bits")
    asked = maybe_repeated(rows, blocks, "__sha", n)
    alone = asked.where(~F.col("__maybe")).select(
        "__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"),
        F.lit(True).alias("__kept"), "__sha",
    )
    shared = asked.where("__maybe").drop("__maybe")
    groups = shared.groupBy("__sha").agg(
        F.count(F.lit(1)).alias("__size"),
        F.min(F.struct((-F.col("__n")).alias("n"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("__best"),
    )
    met = attach(shared, groups, ["__sha"], "__size", n).select(
        "__id", F.col("__best.id").alias("__keep"), "__size",
        (F.col("__row") == F.col("__best.row")).alias("__kept"), "__sha",
    )
    return alone.unionByName(met).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; same choice as :func:`classes`.

    Rows that the filter clears never move. Copies are reduced to the best one before the shuffle,
    so a group of any size sends one row per task. The filter is always broadcast: where one for all rows
    would be larger than BROADCAST_BYTES, hashes alone are shuffled first and only the repeated ones marked.
    """
    names = docs.columns
    hashes = stored(docs.select(F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("__sha")), "hashes")
    n = hashes.count()
    most = BROADCAST_BYTES * 8 // BITS_PER_ROW
    if n <= most:
        bits = repeated_bits(hashes, "__sha", n)
    else:
        n = most
        bits = _marks(hashes.groupBy("__sha").count().where("count > 1"), "__sha", n).distinct()
        bits = bits.groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    asked = maybe_repeated(
        docs.select(
            F.struct(*[docs[c] for c in names]).alias("__whole"),
            F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("__sha"),
        ),
        stored(bits, "bits"), "__sha", n,
    )
    text, ident = F.col("__whole").getField(text_col), F.col("__whole").getField(id_col)
    order = F.struct(-F.char_length(F.coalesce(text, F.lit(""))), ident)
    best = asked.where("__maybe").groupBy("__sha").agg(F.min_by("__whole", order).alias("__whole"))
    return asked.where(~F.col("__maybe")).select("__whole.*").unionByName(best.select("__whole.*"))


def op4_bloom_dedup(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept,
       sha256(body) AS text_sha256
FROM t
WINDOW best AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS FIRST)
"""
