"""Line dedup by winnowing over line hashes.

A document is a sequence of line hashes. Of every ``run`` neighbouring lines the least hash is a
fingerprint, so any repeated run of that length has a fingerprint in common with its first
appearance. Only where a fingerprint occurs more than once are its neighbours looked at: the windows
of ``run`` lines on both sides of each position are compared by content, and every window that has
appeared before is deleted. Longer repeated runs are covered by their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import attach, flags, stored, table
from reportlake.operators.staging import stage

#: Lines of the shortest run that counts as repeated.
RUN = 2
#: A single line of at least so many words is a run by itself.
LONG_LINE = 50
_SPACE = r"[\x09-\x0D\x20]+"


def _line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, _SPACE, " "))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_line: int = LONG_LINE) -> tuple[DataFrame, DataFrame]:
    """The rows, stored with a number each, and per number the indices of the lines to delete.

    Lines are compared with white space collapsed; blank lines are no part of a run and never
    deleted. A window is ``run`` neighbouring lines or one line of ``long_line`` words. Windows are
    ordered by id (null first), text hash, row and line; all but the first of equal windows go.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        F.xxhash64(text).alias("__key"),
        F.col(text_col).alias("__text"),
        F.split(text, "\n").alias("__lines"),
    )
    rows = rows.withColumn(
        "__seq",
        F.filter(
            F.transform(
                "__lines",
                lambda x, i: F.struct(
                    F.xxhash64(_line(x)).alias("h"),
                    i.alias("i"),
                    F.when(F.size(F.split(_line(x), " ")) >= long_line, F.hash(_line(x))).alias("long"),
                    (_line(x) == "").alias("blank"),
                ),
            ),
            lambda s: ~s["blank"],
        ),
    )
    rows = stored(
        rows.select(
            "__row", "__id", "__key", "__text",
            F.col("__seq.h").alias("__h"), F.col("__seq.i").alias("__i"), F.col("__seq.long").alias("__long"),
        ),
        "lines",
    )
    side = run - 1

    around = F.transform(
        "__h",
        lambda h, p: F.struct(
            p.alias("at"), h.alias("h"), F.get("__long", p).alias("long"),
            F.transform(F.sequence(F.lit(-side), F.lit(side)), lambda j: F.get("__h", p + j)).alias("near"),
        ),
    )
    near, middle = F.col("__p.near"), F.col("__p.h")

    def lowest(first: int) -> Column:
        """Is the middle the least of the window that begins ``first`` lines before it?"""
        return F.array_min(F.slice(near, F.lit(side - first + 1), F.lit(run))) >= middle

    kept = F.col("__p.long").isNotNull()
    for first in range(run):
        kept = kept | lowest(first)
    points = stored(
        rows.select("__row", "__id", "__key", F.explode_outer(around).alias("__p"))
        .where(F.col("__p").isNotNull() & kept)
        .select("__row", "__id", "__key", "__p.*"),
        "points",
    )
    total = points.count()
    shared = points.groupBy("h").agg(F.count(F.lit(1)).alias("__count")).where("__count > 1")
    met = attach(points, shared, ["h"], "__count", total).drop("__count")
    # the windows around a meeting point, as start, lines and content
    windows = [
        F.struct(
            (F.col("at") - first).alias("start"),
            F.lit(run).alias("lines"),
            F.slice("near", F.lit(side - first + 1), F.lit(run)).alias("content"),
        )
        for first in range(run)
    ]
    alone = F.when(
        F.col("long").isNotNull(),
        F.struct(F.col("at").alias("start"), F.lit(1).alias("lines"), F.array(F.col("h"), F.col("long").cast("long")).alias("content")),
    )
    windows = stored(
        met.select("__row", "__id", "__key", F.explode_outer(F.array(*windows, alone)).alias("w"))
        .where("w IS NOT NULL AND size(w.content) > 0 AND NOT exists(w.content, x -> x IS NULL)")
        .select("__row", "__id", "__key", "w.*")
        .distinct(),
        "windows",
    )
    place = F.struct(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__row").alias("row"), "start")
    firsts = (
        windows.groupBy("lines", "content")
        .agg(F.count(F.lit(1)).alias("__count"), F.min(place).alias("__first"))
        .where("__count > 1")
    )
    later = attach(windows, firsts, ["lines", "content"], "__count", windows.count()).where(
        (F.col("__row") != F.col("__first.row")) | (F.col("start") != F.col("__first.start"))
    )
    # no more entries than the document has lines
    deleted = (
        later.select("__row", F.explode_outer(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("__at"))
        .groupBy("__row")
        .agg(F.collect_set("__at").alias("__deleted"))
    )
    return rows, deleted


def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per input row: id, text (without the later appearances of repeated runs), n_lines,
    n_deleted and deleted (line numbers from 0).

    Null stays null without lines; an empty text has one (blank) line; a repeated row is a repeated
    run, so all but the first lose what makes runs. Only id and text are read.
    """
    rows, deleted = repeated_lines(docs, id_col, text_col, **options)
    met = rows.select("__row", "__id", "__text", "__i").join(deleted, "__row", "left")
    numbers = F.array_sort(F.transform("__deleted", lambda p: F.get("__i", p)))
    met = stage(met, __gone=F.coalesce(numbers, F.array().cast("array<int>")))
    met = stage(met, __flags=flags(F.col("__gone")))
    kept = F.filter(F.split("__text", "\n"), lambda x, i: F.substring("__flags", i + 1, F.lit(1)) != F.lit(b"1"))
    return met.select(
        F.col("__id").alias(id_col),
        F.when(F.size("__gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("__text")).alias(text_col),
        F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(F.split("__text", "\n"))).cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_deleted"),
        F.col("__gone").alias("deleted"),
    )


def op10_line_winnowing(spark, sf_dir):
    found = without_repeated_runs(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_deleted",
        F.array_join(F.transform("deleted", lambda i: i.cast("string")), ",").alias("deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS i,
             unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
c AS (SELECT r, i, trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')) AS body FROM l),
s AS (SELECT r, i, body, row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM c WHERE body <> ''),
w AS (
  SELECT a.r, a.p, 2 AS n, a.body AS x, b.body AS y FROM s a JOIN s b ON a.r = b.r AND b.p = a.p + 1
  UNION ALL SELECT r, p, 1, body, '' FROM s WHERE len(string_split(body, ' ')) >= 50),
later AS (SELECT r, p, n FROM w QUALIFY row_number() OVER (PARTITION BY n, x, y ORDER BY r, p) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(p, p + n - 1)) AS p FROM later),
kept AS (SELECT l.r, l.i, l.line, g.r IS NOT NULL AS deleted
         FROM l LEFT JOIN s USING (r, i) LEFT JOIN gone g ON g.r = s.r AND g.p = s.p)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines, n_deleted, deleted, sha256(body) AS text_sha256
FROM d JOIN (
  SELECT r, count(*) AS n, count(*) FILTER (WHERE deleted) AS n_deleted,
         coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (WHERE deleted), '') AS deleted,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT deleted), '') AS body
  FROM kept GROUP BY r) USING (r)
"""
