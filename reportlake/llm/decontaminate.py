"""Benchmark decontamination by winnowing.

Every run of ``span`` words is covered by ``span - k + 1`` word k-grams. Documents and items both
keep the grams whose hash is the least of some such window, so a shared run of ``span`` words always
has a kept gram in common. Kept grams are joined by hash; each meeting point is compared word by
word and extended to both sides, which also discards equal hashes of different words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import NO_WORD, flags, lowered, stored, words
from reportlake.operators.staging import stage

GRAM = 5
SPAN = 10
#: Rows of a side that are broadcast at most, and their bytes as JSON.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Slots for each hash of a document that its grams are asked by; one in so many others passes too.
SLOTS = 32


def _sliding(df: DataFrame, column: str, width: int, join) -> tuple[DataFrame, str]:
    """Joins every ``width`` neighbours of an array in about log(width) passes over it.

    ``join`` must allow overlap (a hash of hashes, a minimum). Entries near the end, where fewer
    neighbours are left, hold what is joined of those.
    """
    have = 1
    while have < width:
        step = min(have, width - have)
        name = f"{column}_{have + step}"
        later = F.slice(column, F.lit(step + 1), F.greatest(F.size(column) - step, F.lit(0)))
        # read twice, so Spark keeps the narrower array as a column of its own
        df = df.withColumn(name, F.zip_with(column, later, join)).drop(column)
        column, have = name, have + step
    return df, column


def _grams(df: DataFrame, words_col: str, k: int) -> tuple[DataFrame, str]:
    hashed = df.withColumn("__g", F.transform(words_col, lambda x: F.xxhash64(x)))
    return _sliding(hashed, "__g", k, lambda a, b: F.xxhash64(a, b))


def _minima(df: DataFrame, words_col: str, need: int, k: int) -> tuple[DataFrame, str]:
    """The least gram hash of every window that ``need`` words fill."""
    grams, column = _grams(df, words_col, k)
    return _sliding(grams, column, need - k + 1, lambda a, b: F.least(a, b))


def _beside(text: Column, first: Column, step: int, most: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(text, first + F.lit(step) * i))


def _equal_run(a: str, b: str, most: int) -> Column:
    """Equal entries in a row at the start of two arrays, up to ``most``."""
    count: Column = F.lit(most)
    for i in range(most, 0, -1):
        same = F.get(F.col(a), F.lit(i - 1)) == F.get(F.col(b), F.lit(i - 1))
        count = F.when(F.coalesce(same, F.lit(False)), count).otherwise(F.lit(i - 1))
    return count


def _slot(h: Column) -> Column:
    return F.pmod(h, F.col("__slots")).cast("int")


def _points(df: DataFrame, chosen: str, k: int, side: int) -> DataFrame:
    """A row for every gram whose hash is in the array ``chosen``, with the words around it.

    Grams are asked by a slot of their hash, a byte each, so that time does not grow with the length of
    ``chosen``; a few grams whose hash only shares a slot come along.
    """
    keys = [c for c in df.columns if c not in ("__words", chosen)]
    grams, column = _grams(df, "__words", k)
    staged = stage(grams, __all=F.transform(column, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = stage(staged, __slots=F.greatest(F.size(chosen), F.lit(1)) * SLOTS)
    staged = stage(staged, __taken=F.array_sort(F.array_distinct(F.transform(chosen, _slot))))
    staged = stage(staged, __flags=flags(F.col("__taken")))
    met = stage(staged, __met=F.filter("__all", lambda x: F.substring("__flags", _slot(x["h"]) + 1, F.lit(1)) == F.lit(b"1")))
    w = F.col("__words")
    around = F.transform(
        "__met",
        lambda x: F.struct(
            x["h"].alias("hash"),
            x["i"].alias("at"),
            F.slice(w, x["i"] + 1, F.lit(k)).alias("gram"),
            _beside(w, x["i"] - 1, -1, side).alias("left"),
            _beside(w, x["i"] + k, 1, side).alias("right"),
        ),
    )
    return met.select(*keys, F.explode_outer(around).alias("__p")).where("__p IS NOT NULL").select(*keys, "__p.*")


def _fingerprints(items: DataFrame, need: int, k: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Grams, with the words around them, that are least in a window of an item of this length, each with a
    number; and the items of every number, a row each."""
    own = items.where(F.least(F.size("__words"), F.lit(span)) == need)
    kept, column = _minima(own.withColumn("__copy", F.col("__words")), "__copy", need, k)
    kept = kept.select("__item", "__words", F.array_distinct(column).alias("__kept"))
    points = stored(_points(kept, "__kept", k, span - 1).where(F.size("gram") == k), f"points{need}")
    gram = ["hash", "gram", "left", "right"]
    prints = stored(points.select(*gram).distinct().withColumn("__print", F.monotonically_increasing_id()), f"prints{need}")
    return prints, stored(points.join(prints, gram).select("__print", "__item").distinct(), f"named{need}")


def find_spans(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    k: int = GRAM,
) -> DataFrame:
    """Words of each document that lie in a window of an item.

    A window is ``span`` consecutive words of an item, or all words of a shorter item. Returns one
    row per input row: id, text_key (hash of the text), n_words, spans (sorted separate
    array<struct<start, end>> of word positions, end exclusive) and items (distinct ids).

    Null or wordless texts have no spans; items without words match nothing; repeated rows each get
    a row; an empty benchmark gives rows without spans. Other columns are not read, so names cannot
    clash.
    """
    listed = stored(
        items.select(F.col(item_col).alias("__item"), words(F.col(item_text)).alias("__words"))
        .where(F.size("__words") > 0)
        .distinct(),
        "items",
    )
    # at most ``span`` different numbers, whatever the benchmark
    lengths = listed.select(F.least(F.size("__words"), F.lit(span))).distinct()
    needs = sorted(r[0] for r in lengths.collect())
    texts = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        F.xxhash64(text_col).alias("__key"),
        # an empty first or last entry is no word and equals none
        F.split(lowered(F.col(text_col)), NO_WORD).alias("__words"),
    )
    empty = (F.get("__words", F.lit(0)) == "").cast("int") + (
        (F.size("__words") > 1) & (F.element_at("__words", -1) == "")
    ).cast("int")
    texts = texts.withColumn("__n", F.size("__words") - empty)
    keys = ["__row", "__id", "__key", "__n"]
    prints, named, seen = {}, {}, []
    for need in needs:
        size = min(k, need)
        prints[need], named[need] = _fingerprints(listed, need, size, span)
        least, column = _minima(texts, "__words", need, size)
        first = F.array(F.lit(None).cast("bigint"))  # a row for the document itself
        hashes = least.select(*keys, F.explode_outer(F.concat(first, F.col(column))).alias("hash"))
        known = prints[need].select("hash", F.lit(need).alias("__need")).distinct()
        seen.append(
            hashes.join(_checked(known), "hash", "left").where("hash IS NULL OR __need IS NOT NULL")
        )
    if not needs:
        seen = [texts.select(*keys, F.lit(None).cast("bigint").alias("hash"), F.lit(0).alias("__need"))]
    seen = stored(reduce(lambda a, b: a.unionByName(b), seen), "seen")
    rows = seen.where("hash IS NULL").select(*keys)
    rows = rows.distinct() if len(needs) > 1 else rows
    met = stored(
        seen.where("hash IS NOT NULL")
        .groupBy("__id", "__key", "__need")
        .agg(F.collect_set("hash").alias("__chosen")),
        "met",
    )
    spans = [_spans(docs, met.where(F.col("__need") == n), p, id_col, text_col, n, min(k, n), span) for n, p in prints.items()]
    if not spans:
        return rows.select(
            F.col("__id").alias(id_col),
            F.col("__key").alias("text_key"),
            F.col("__n").cast("long").alias("n_words"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
            F.array().cast(f"array<{dict(listed.dtypes)['__item']}>").alias("items"),
        )
    spans = stored(reduce(lambda a, b: a.unionByName(b), spans), "spans")
    held = reduce(lambda a, b: a.unionByName(b), [n.withColumn("__need", F.lit(need)) for need, n in named.items()])
    found = _joined(spans).groupBy("__id", "__key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    # a row for each document and item, then one for each document
    theirs = spans.select("__id", "__key", "__need", "__print").distinct().join(_checked(held), ["__need", "__print"])
    theirs = theirs.groupBy("__id", "__key").agg(F.collect_set("__item").alias("__items"))
    theirs = theirs.select(F.col("__id").alias("__tid"), F.col("__key").alias("__tkey"), "__items")
    found = found.join(theirs, F.col("__id").eqNullSafe(F.col("__tid")) & (F.col("__key") == F.col("__tkey"))).select(
        F.col("__id").alias("__fid"), F.col("__key").alias("__fkey"), "__spans", "__items"
    )
    same = F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__key") == F.col("__fkey"))
    return rows.join(found, same, "left").select(
        F.col("__id").alias(id_col),
        F.col("__key").alias("text_key"),
        F.col("__n").cast("long").alias("n_words"),
        F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("__items", F.array().cast(found.schema["__items"].dataType)).alias("items"),
    )


def _checked(side: DataFrame) -> DataFrame:
    """A side of stored rows, broadcast if it is small; else Spark joins by shuffle."""
    few = side.limit(BROADCAST_ROWS + 1) if BROADCAST_ROWS >= 0 else side.limit(1)
    size = F.length(F.to_json(F.struct(*side.columns))).cast("long")
    n, total = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(side) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else side


def _spans(docs, met, prints, id_col, text_col, need, k, span) -> DataFrame:
    """Meeting points of some documents, compared word by word and extended to both sides."""
    met = met.select(F.col("__id").alias("__mid"), F.col("__key").alias("__mkey"), "__chosen")
    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))
    same = F.col("__id").eqNullSafe(F.col("__mid")) & (F.col("__key") == F.col("__mkey"))
    own = own.join(_checked(met), same).select("__id", "__key", words(F.col("__text")).alias("__words"), "__chosen")
    points = _points(own, "__chosen", k, span - 1)
    known = prints.select("hash", *[F.col(c).alias(f"__{c}") for c in ("gram", "left", "right")], "__print")
    before, after = _equal_run("left", "__left", span - 1), _equal_run("right", "__right", span - 1)
    return (
        points.join(_checked(known), "hash")
        .where(F.col("gram") == F.col("__gram"))
        .select(
            "__id", "__key", F.lit(need).alias("__need"), "__print",
            (F.col("at") - before).alias("start"), (F.col("at") + F.lit(k) + after).alias("end"),
        )
        .where(F.col("end") - F.col("start") >= need)
    )


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of each document, with those that touch or overlap made one."""
    longest = spans.groupBy("__id", "__key", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("__id", "__key").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = longest.withColumn("__new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    runs = begun.withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy("__id", "__key", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a checksum per document from the rows of :func:`find_spans`."""
    hit = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows, with all their columns, that share no window with an item."""
    found = find_spans(docs, items, id_col, text_col, **options)
    bad = found.where(F.size("spans") > 0).select(
        F.col(id_col).alias("__id"), F.col("text_key").alias("__key")
    )
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key"))
    return docs.join(bad, same, "left_anti")


def op9_winnowing(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(find_spans(docs, items))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p.n, i, item_id FROM places p JOIN windows v ON p.n = v.n AND p.words = v.words),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
