"""Passage dedup by winnowing over words, wherever in a line a passage begins or ends.

Every window of ``span`` words that appeared before is deleted. A window picks the least hash of its
runs of half that length; neighbouring windows that pick the same run make up a point, so equal
windows lie at the same place of points with the same run. Points of equal content are settled as a
whole; only where one run has several contents are the windows of each content's first point compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm import textmap
from reportlake.llm.common import attach, stored, table

#: Words of the shortest passage that counts as repeated.
SPAN = 50
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POINT = "lo int, cnt int, g bigint, c1 bigint, c2 bigint"


def _words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word between white space, and where each text's words begin."""
    inside = ~_IS_SPACE[raw]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    border = ends[:-1][ends[:-1] < len(raw)]
    before[border] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[border[border > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, stops, np.zeros(len(ends), np.int64)
    lengths = stops - starts
    letters = np.flatnonzero(inside)
    place = letters - np.repeat(starts, lengths)
    values = textmap._VALUES[raw[letters]] * textmap._powers(int(lengths.max()))[place]
    hashes = textmap.mix(np.add.reduceat(values, np.cumsum(lengths) - lengths))
    return hashes, starts, stops, np.searchsorted(starts, ends)


class _Runs:
    """Hashes of any run of words by differences of sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.cumprod(np.full(n, base, np.uint64)), dtype=np.uint64)])
        self.back = np.cumprod(back)

    def __call__(self, at: np.ndarray, n) -> np.ndarray:
        return textmap.mix((self.sums[at + n] - self.sums[at]) * self.back[at])


def _points(hashes: np.ndarray, bounds: np.ndarray, span: int):
    """Per point: text, first window, number of windows, hash of the run and two of all its words."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(hashes)) + span <= last)
    if not len(at):
        return [np.zeros(0, np.int64)] * 6
    gram = (span + 1) // 2
    one, two = (_Runs(hashes, b) for b in _BASES)
    grams = one(np.arange(len(hashes) - gram + 1), gram)
    picked = at + sliding_window_view(grams, span - gram + 1)[at].argmin(axis=1)
    text = np.searchsorted(bounds, at, side="right") - 1
    new = np.flatnonzero(np.diff(picked, prepend=-1) | np.diff(text, prepend=-1))
    lo, count = at[new], np.diff(np.append(new, len(at)))
    size = count + span - 1
    signed = [x.view(np.int64) for x in (grams[picked[new]], one(lo, size), two(lo, size))]
    return [text[new], lo - bounds[text[new]], count, *signed]


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Per input row: id, text (without the later appearances of repeated passages), n_words, n_deleted
    and deleted (ranges of word numbers from 0, end excluded).

    Words lie between white space and are compared as they are. Windows of ``span`` words are ordered
    by id (null first), text hash, row and place; all but the first of equal windows go, each word
    with the white space after it. A passage that overlaps its own first appearance (one word again
    and again) goes from its second beginning on. Null stays null; only id and text are read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__key"), F.col(text_col).alias("__text"),
    )
    kind = rows.schema["__id"].dataType.simpleString()
    rows = stored(rows, "texts")
    place = ["__id", "__key", "__row"]

    def points(batches):
        for batch in batches:
            for part in textmap.slices(batch, "__text"):
                hashes, _, _, bounds = _words(*textmap.text_bytes(part.column("__text")))
                text, lo, count, *marks = _points(hashes, bounds, span)
                own = [part.column(n).take(pa.array(text)) for n in place]
                out = [*own, pa.array(lo, pa.int32()), pa.array(count, pa.int32()), *map(pa.array, marks)]
                yield pa.RecordBatch.from_arrays(out, [*place, "lo", "cnt", "g", "c1", "c2"])

    head = f"__id {kind}, __key bigint, __row bigint"
    found = stored(rows.select(*place, "__text").mapInArrow(points, f"{head}, {_POINT}"), "points")
    total = found.count()
    first = F.min(F.struct(*place, "lo"))
    content = ["g", "c1", "c2", "cnt"]
    groups = stored(found.groupBy(*content).agg(F.count(F.lit(1)).alias("__n"), first.alias("__first")), "contents")
    later = attach(found, groups.where("__n > 1"), content, "__n", total)
    later = later.where("__row <> __first.__row OR lo <> __first.lo").select("__row", "lo", "cnt")
    several = groups.groupBy("g").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1")
    open_ = attach(groups.select("g", "cnt", "__first"), several, ["g"], "__k", total)
    asked = open_.groupBy(F.col("__first.__row").alias("__row")).agg(
        F.collect_list(F.struct(F.col("__first.lo").alias("lo"), "cnt")).alias("asked")
    )

    def windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                hashes = _words(*textmap.text_bytes(part.column("__text")))[0]
                at = np.concatenate([np.arange(p["lo"], p["lo"] + p["cnt"]) for p in part.column("asked")[0].as_py()])
                marks = [pa.array(_Runs(hashes, b)(at, span).view(np.int64)) for b in _BASES]
                own = [part.column(n).take(pa.array(np.zeros(len(at), np.int64))) for n in place]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), *marks], [*place, "lo", "c1", "c2"])

    # both sides have a row once
    compared = rows.join(asked, "__row").select(*place, "__text", "asked")
    compared = stored(compared.mapInArrow(windows, f"{head}, lo int, c1 bigint, c2 bigint"), "windows")
    firsts = compared.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("__n"), first.alias("__first")).where("__n > 1")
    more = attach(compared, firsts, ["c1", "c2"], "__n", compared.count())
    more = more.where("__row <> __first.__row OR lo <> __first.lo").select("__row", "lo", F.lit(1).alias("cnt"))
    gone = later.unionByName(more).groupBy("__row").agg(F.collect_list(F.struct("lo", "cnt")).alias("gone"))

    def cut(batches):
        for batch in batches:
            texts, counts, ranges = [], [], []
            for text, gone_ in zip(batch.column("__text").to_pylist(), batch.column("gone").to_pylist()):
                raw = (text or "").encode()
                _, starts, _, _ = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                edge = np.zeros(len(starts) + 1, np.int64)
                for p in gone_ or []:
                    edge[p["lo"]] += 1
                    edge[p["lo"] + p["cnt"] + span - 1] -= 1
                steps = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
                spans = list(zip(steps[::2].tolist(), steps[1::2].tolist()))
                marks = [*starts.tolist(), len(raw)]
                keep, at = [], 0
                for a, b in spans:
                    keep.append(raw[at : marks[a]])
                    at = marks[b]
                texts.append(None if text is None else b"".join([*keep, raw[at:]]).decode())
                counts.append((len(starts), sum(b - a for a, b in spans)))
                ranges.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)),
                    pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["__id", "text", "n_words", "n_deleted", "deleted"],
            )

    met = rows.join(gone, "__row", "left").select("__id", "__text", "gone")
    done = met.mapInArrow(cut, f"__id {kind}, text string, n_words bigint, n_deleted bigint, deleted array<struct<start:bigint,end:bigint>>")
    return done.select(F.col("__id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_deleted", "deleted")


def op10_passages(spark, sf_dir):
    found = without_repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("deleted", lambda d: F.concat_ws("-", d["start"].cast("string"), d["end"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_deleted", F.array_join(spans, ",").alias("deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
