"""Documents to lines.

A document arrives as one row and its lines stay in one array of that row until
the last moment, so look-ahead, page breaks and stage order need no shuffle: the
work is a narrow map over documents however uneven their number per key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.operators.staging import per_plan, stage

FEED = "\f"


def split_lines(value: Column) -> Column:
    """Lines end at ``\n`` only; carriage returns are taken off both ends, spaces are not."""
    clean = F.when(
        value.contains("\r"),
        F.regexp_replace(F.btrim(value, F.lit("\r")), r"\r*\n\r*", "\n"),
    ).otherwise(value)
    return F.split(clean, "\n")


def kept_lines(value: Column, **marks) -> Column:
    """``array<struct<n, l, ...>>``: lines with text, and their number in the document.

    Lines of length zero are dropped, lines of spaces stay.  ``marks`` are
    further fields, each made from the line.
    """

    def entry(line: Column, i: Column) -> Column:
        more = [make(line).alias(name) for name, make in marks.items()]
        return F.struct((i + 1).alias("n"), line.alias("l"), *more)

    return F.filter(F.transform(split_lines(value), entry), lambda x: x["l"] != "")


def starts_page(line: Column) -> Column:
    return F.coalesce(line.startswith(FEED), F.lit(False))


def current_positions(kept: Column, has_feed: Column) -> Column:
    """Zero-based positions in ``kept`` of the lines a parser looks at.

    A line counts when another one follows it that does not begin a page.  So
    the last line of a document and the footer before a page break never do.
    A first line that begins a page takes the place of the start-up look-ahead:
    the first position is then skipped.
    """
    n = F.size(kept)
    none = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), n - 2)
    current = F.filter(every, lambda i: ~starts_page(F.get(kept, i + 1)["l"]))
    opening = starts_page(F.get(kept, F.lit(0))["l"])
    return (
        F.when(n < 2, none)
        .when(~has_feed, every)
        .when(opening, F.slice(current, F.lit(2), n))
        .otherwise(current)
    )


@per_plan
def _current_of_kept() -> Column:
    return current_positions(F.col("kept"), F.col("has_feed"))


def with_lines(docs: DataFrame, value: str = "value", kept: Column | None = None) -> DataFrame:
    """Replace the document text by its ``kept`` lines and their ``current`` positions."""
    others = [c for c in docs.columns if c != value]
    text = F.col(value)
    kept = kept_lines(text) if kept is None else kept
    staged = stage(docs, kept=kept, has_feed=text.contains(FEED)).select(*others, "kept", "has_feed")
    return stage(staged, current=_current_of_kept())


def explode_lines(docs: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """``lines(key, line_no, line, line_next, is_current, page_no)``; no shuffle.

    ``page_no`` counts the page breaks up to and including the line.
    """
    kept, pages = F.col("kept"), F.col("pages")
    staged = stage(docs.select(key, value), kept=kept_lines(F.col(value)))
    starts = F.transform(kept, lambda x, i: F.when(starts_page(x["l"]), i))
    staged = stage(staged, pages=F.array_compact(starts))
    # Page by page: every line of [pages[p-1], pages[p]) has page number p.
    entries = F.flatten(
        F.transform(F.sequence(F.lit(0), F.size(pages)), lambda p: _page_lines(kept, pages, p))
    )
    rows = staged.select(key, F.explode(entries).alias("e"))
    follows = F.col("e.line_next").isNotNull() & ~starts_page(F.col("e.line_next"))
    return rows.select(
        key,
        F.col("e.n").alias("line_no"),
        F.col("e.l").alias("line"),
        F.col("e.line_next").alias("line_next"),
        (follows & ~F.col("e.opening")).alias("is_current"),
        F.col("e.page").alias("page_no"),
    )


def _page_lines(kept: Column, pages: Column, p: Column) -> Column:
    """Lines of page ``p`` with look-ahead; ``opening`` while only breaks were seen."""
    begin = F.when(p == 0, F.lit(0)).otherwise(F.get(pages, p - 1))
    end = F.coalesce(F.get(pages, p), F.size(kept))
    return F.transform(
        F.slice(kept, begin + 1, end - begin),
        lambda x, i: F.struct(
            x["n"].alias("n"),
            x["l"].alias("l"),
            F.get(kept, begin + i + 1)["l"].alias("line_next"),
            p.alias("page"),
            (begin + i + 1 == p).alias("opening"),
        ),
    )


def cut_at_bad_bytes(docs: DataFrame, value: str = "value", bad: str = "bad_line") -> DataFrame:
    """Documents up to their first line that is no valid UTF-8, and the number of that line.

    ``bad`` is null where all lines can be decoded; only other documents are taken apart.
    """
    # One character per byte: lines can be taken apart before they are decoded.
    raw = F.split(F.decode(F.col(value).cast("binary"), "ISO-8859-1"), "\n")
    lines = F.transform(raw, lambda l: F.encode(l, "ISO-8859-1").cast("string"))

    def cut(decoded: Column) -> Column:
        at = F.array_position(F.transform(decoded, lambda l: F.is_valid_utf8(l)), F.lit(False)).cast("int")
        return F.struct(F.array_join(F.slice(decoded, F.lit(1), at - 1), "\n").alias("text"), at.alias("at"))

    found = F.get(F.transform(F.array(lines), cut), F.lit(0))
    others = [c for c in docs.columns if c != value]
    staged = stage(docs, _cut=F.when(~F.is_valid_utf8(F.col(value)), found))
    return staged.select(*others, F.coalesce("_cut.text", F.col(value)).alias(value), F.col("_cut.at").alias(bad))


def split_undecodable(docs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Documents cut to their valid UTF-8 lines, and the ones that were cut.

    Reading stops at the first line that cannot be decoded; rows before it stay.
    ``value`` is binary.
    """
    # One character per byte: lines can be taken apart before they are decoded.
    bytes_ = F.split(F.decode(F.col(value), "ISO-8859-1"), "\n")
    decoded = F.transform(bytes_, lambda l: F.encode(l, "ISO-8859-1").cast("string"))
    staged = stage(docs, decoded=decoded)
    good = F.transform(F.col("decoded"), lambda l: F.is_valid_utf8(l))
    staged = stage(staged, first_bad=F.array_position(good, F.lit(False)).cast("int"))
    read = F.when(F.col("first_bad") == 0, F.col("decoded")).otherwise(
        F.slice(F.col("decoded"), F.lit(1), F.col("first_bad") - 1)
    )
    others = [c for c in docs.columns if c != value]
    texts = staged.select(*others, F.array_join(read, "\n").alias(value))
    cut = staged.where(F.col("first_bad") > 0)
    return texts, cut.select(*others, F.col("first_bad").alias("line_no"))
