"""Phrase collocation mining over suffix subtrees, partitioned by word prefixes.

Every word begins a suffix of up to ``longest`` words that ends with its piece of text. The tree of all
these suffixes is never built whole. A first pass counts how often prefixes occur; a prefix that begins
more suffixes than a group may hold is extended by its next word, again and again, and the prefixes that
result are dealt to groups of about ``budget`` suffixes. A second pass sends each suffix to its group,
which sorts its own and so builds its part of the tree alone: the nodes are the runs of equal beginnings,
and the count of a phrase is the sum of the leaves below its node. Nodes above the prefix of a group,
and those of a group that was taken in several parts, are summed over groups.

The first pass also marks, in two bitmaps of fixed size, the words and word pairs that can occur often
enough at all. A suffix ends before the first pair that cannot, which loses no frequent phrase.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import stored, table
from reportlake.llm.textmap import LOWER, SLICE_BYTES, mix

LEAST = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one around it has at least so many hundredths of its occurrences.
COVER = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Suffixes of one group, which a task holds at a time (about 100 bytes each).
BUDGET = 1 << 19
#: Groups at most; beyond it they grow and are taken in several parts.
GROUPS = 1 << 14
#: Buckets of the counts of words, of pairs, and of prefixes of each length.
WORD_BITS, PAIR_BITS, PREFIX_BITS = 20, 22, 14
#: Counts of several tasks that are added up at a time.
FAN_IN = 64
#: Rows that one task ranks.
RANKED = 100_000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_AHEAD = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0A-\x0D]+){0,%d}" % (LONGEST - 1))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _parts(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about a slice, each with the length that is its own.

    Cut at a break if there is one, else at a blank; the words after such a cut that a suffix may reach
    follow the part as a context that belongs to the next part.
    """
    at = 0
    while len(text) - at > 2 * SLICE_BYTES:
        window = np.frombuffer(text, np.uint8, SLICE_BYTES, at)
        stops = np.flatnonzero(_BREAK[window])
        stops = stops if len(stops) else np.flatnonzero(_BLANK[window])
        if len(stops):
            cut = at + int(stops[-1]) + 1
        else:  # one word longer than a slice
            found = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]").search(text, at)
            cut = found.end() if found else len(text)
        ahead = b"" if _BREAK[text[cut - 1]] else _AHEAD.match(text, cut).group()
        yield text[at:cut] + ahead, cut - at
        at = cut
    yield text[at:], len(text) - at


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int], list[str]]]:
    """Texts with the lengths that count and their languages, about a slice of bytes at a time."""
    texts, own, langs, size = [], [], [], 0
    for text, lang in zip(batch.column("__text"), batch.column("__lang").to_pylist()):
        value = text.as_buffer()
        if value is None:
            continue
        for part, length in _parts(value.to_pybytes()):
            texts.append(part)
            own.append(length)
            langs.append(lang)
            size += len(part) + 64
            if size >= SLICE_BYTES:
                yield texts, own, langs
                texts, own, langs, size = [], [], [], 0
    if texts:
        yield texts, own, langs


def _byte_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of a non-empty list; only where things go depends on it."""
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(mix((data.astype(np.uint64) + np.uint64(1)) * _MIX + place.astype(np.uint64)), starts))


class _Words:
    """The words of a slice in order, and how far the suffix of each may reach."""

    def __init__(self, texts: list[bytes], own: list[int], langs: list[str]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        inside = ~(_BREAK[raw] | _BLANK[raw])
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        first = bounds[:-1][bounds[:-1] < len(raw)]
        begin[first] = inside[first]
        starts = np.flatnonzero(begin)
        self.count = len(starts)
        if not self.count:
            return
        text = np.searchsorted(bounds, starts, side="right") - 1
        self.own = starts - bounds[text] < np.asarray(own)[text]
        self.languages, which = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.lang = which[text]
        broken = np.cumsum(_BREAK[raw])[starts]
        #: Is the next word in the same piece?
        self.next = np.zeros(self.count, bool)
        self.next[:-1] = (text[1:] == text[:-1]) & (broken[1:] == broken[:-1])
        letters = np.flatnonzero(inside)
        word = np.cumsum(begin)[letters] - 1
        data = LOWER[raw[letters]]
        at = np.searchsorted(letters, starts)
        self.length = np.diff(np.append(at, len(letters)))
        #: All words, each with a blank after it, and where each begins.
        self.joined = np.full(len(data) + self.count, 0x20, np.uint8)
        self.joined[np.arange(len(data)) + word] = data
        self.offset = at + np.arange(self.count)
        coded = _encoded(data, np.append(at, len(data)))
        self.ids = coded.indices.to_numpy().astype(np.int64)
        kinds = coded.dictionary
        self.kinds = len(kinds)
        cuts = np.frombuffer(kinds.buffers()[1], np.int64)[: self.kinds + 1]
        hashes = _byte_hashes(np.frombuffer(kinds.buffers()[2], np.uint8)[: cuts[-1]], cuts[:-1])
        seeds = np.array([zlib.crc32(str(x).encode()) + 1 for x in self.languages], np.uint64) * _MIX
        self.hash = mix(hashes[self.ids] ^ seeds[self.lang])

    def prefixes(self) -> list[np.ndarray]:
        """Hashes of the first one, two, … words from each word on, wherever they end."""
        out = [self.hash]
        for d in range(1, LONGEST):
            later = np.zeros(self.count, np.uint64)
            later[:-d] = self.hash[d:] if d < self.count else later[:-d]
            out.append(mix(out[-1] * _MIX + later))
        return out


def _encoded(data: np.ndarray, offsets: np.ndarray) -> pa.DictionaryArray:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()


def _reach(following: np.ndarray) -> np.ndarray:
    """Words of the suffix at each word, where ``following`` says whether the next one still belongs to it."""
    reach, ok = np.ones(len(following), np.int64), following.copy()
    for d in range(1, LONGEST):
        reach += ok
        after = np.zeros_like(following)
        after[:-d] = following[d:] if d < len(following) else after[:-d]
        ok &= after
    return reach


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class _Counts:
    """What a task counts in the first pass."""

    #: The bits of each table; words and pairs only have to tell whether they reach ``least``.
    BITS = {"word": WORD_BITS, "pair": PAIR_BITS, **{f"prefix{d}": PREFIX_BITS for d in range(1, LONGEST)}}
    BLOCK = 1 << 16

    def __init__(self, least: int):
        self.least = least
        self.sums = {k: np.zeros(1 << bits, np.int64 if k[:6] == "prefix" else np.uint8) for k, bits in self.BITS.items()}
        self.total: dict[str, int] = {}

    def add(self, words: _Words) -> None:
        for i, lang in enumerate(words.languages):
            self.total[lang] = self.total.get(lang, 0) + int((words.own & (words.lang == i)).sum())
        reach, prefixes = _reach(words.next), words.prefixes()
        for d in range(1, LONGEST):
            here = prefixes[d - 1][words.own & (reach >= d)]
            self._count(f"prefix{d}", here)
            if d < 3:
                self._count("word" if d == 1 else "pair", here)

    def _count(self, name: str, hashes: np.ndarray) -> None:
        sums = self.sums[name]
        if sums.dtype == np.int64:
            sums += np.bincount(_bucket(hashes, self.BITS[name]), minlength=len(sums))
        else:
            where, n = np.unique(_bucket(hashes, self.BITS[name]), return_counts=True)
            sums[where] = np.minimum(sums[where] + n, self.least)

    def rows(self, part: int) -> Iterator[tuple[str, int, int, bytes]]:
        for name, sums in self.sums.items():
            for block in range(0, len(sums), self.BLOCK):
                cut = sums[block : block + self.BLOCK]
                if cut.any():
                    yield name, block // self.BLOCK, part, zlib.compress(cut.tobytes(), 1)
        for lang, n in self.total.items():
            yield f"lang:{lang}", 0, part, zlib.compress(np.array([n], np.int64).tobytes(), 1)


_COUNT_SCHEMA = "name string, block int, part bigint, sums binary"


def _unpacked(name: str, data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8 if name in ("word", "pair") else np.int64)


def _counted(frame: DataFrame, least: int) -> DataFrame:
    """The counts of all tasks, added up block by block, some tasks' at a time."""

    def count(batches):
        counts = _Counts(least)
        for batch in batches:
            for slice_ in _slices(batch):
                words = _Words(*slice_)
                if words.count:
                    counts.add(words)
        for row in counts.rows(TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "block", "part", "sums"), row))], schema=schema)

    schema = pa.schema([("name", pa.string()), ("block", pa.int32()), ("part", pa.int64()), ("sums", pa.binary())])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        name, total = rows["name"][0], None
        for data in rows["sums"]:
            here = _unpacked(name, data)
            if total is None:
                total = here.copy()
            elif total.dtype == np.uint8:
                total = np.minimum(total + here, least).astype(np.uint8)
            else:
                total += here
        return pd.DataFrame([[name, rows["block"][0], rows["__to"][0], zlib.compress(total.tobytes(), 1)]], columns=["name", "block", "part", "sums"])

    counts = stored(frame.mapInArrow(count, _COUNT_SCHEMA), "counts")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        met = counts.withColumn("__to", F.floor(F.col("part") / FAN_IN)).groupBy("name", "block", "__to")
        counts = stored(met.applyInPandas(added, _COUNT_SCHEMA), "counts")
        parts = -(-parts // FAN_IN)
    return counts


class _Tables:
    """What the second pass needs to know, of fixed size: bitmaps and the prefixes to extend."""

    def __init__(self, counts: DataFrame, least: int, budget: int):
        # blocks of fixed number and size, and a number for each language
        rows = counts.select("name", "block", "sums").collect()
        self.n = {r["name"][5:]: int(_unpacked(r["name"], r["sums"])[0]) for r in rows if r["name"].startswith("lang:")}
        total = sum(self.n.values())
        self.groups = int(min(max(1, -(-total // budget)), GROUPS))
        most = max(budget, total >> PREFIX_BITS - 2)
        self.heavy = [np.zeros(1 << PREFIX_BITS, bool) for _ in range(LONGEST)]
        self.known = {k: np.zeros((1 << _Counts.BITS[k]) // 8, np.uint8) for k in ("word", "pair")}
        for r in rows:
            name, block = r["name"], r["block"] * _Counts.BLOCK
            if name in self.known:
                marks = np.packbits(_unpacked(name, r["sums"]) >= least)
                self.known[name][block // 8 : block // 8 + len(marks)] = marks
            elif name.startswith("prefix"):
                self.heavy[int(name[6:])][:] = _unpacked(name, r["sums"]) > most

    def often(self, name: str, hashes: np.ndarray) -> np.ndarray:
        at = _bucket(hashes, _Counts.BITS[name])
        return (self.known[name][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _suffix_blocks(words: _Words, tables: _Tables) -> Iterator[tuple[int, str, int, int, bytes]]:
    """Different suffixes of a slice with their counts, packed for each group and language."""
    prefixes = words.prefixes()
    reach = _reach(words.next & tables.often("pair", prefixes[1]))
    chosen = np.flatnonzero(words.own & tables.often("word", prefixes[0]))
    if not len(chosen):
        return
    reach = reach[chosen]
    base = words.kinds + 1
    ids = [np.where(reach > d, words.ids[np.minimum(chosen + d, words.count - 1)] + 1, 0) for d in range(LONGEST)]
    front, back = (words.lang[chosen] * base + ids[0]) * base + ids[1], ids[2] * base + ids[3]
    order = np.lexsort((back, front))
    front, back = front[order], back[order]
    new = np.append(True, (front[1:] != front[:-1]) | (back[1:] != back[:-1]))
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    leaf, reach = chosen[order[new]], reach[order[new]]
    # the prefix that names the group: extended while too many suffixes begin with it
    deep, name = np.ones(len(leaf), np.uint8), prefixes[0][leaf]
    more = np.ones(len(leaf), bool)
    for d in range(1, LONGEST):
        more &= (reach >= d) & tables.heavy[d][_bucket(prefixes[d - 1][leaf], PREFIX_BITS)]
        deep += more
        name = np.where(more & (reach > d), prefixes[d][leaf], name)
    group = (mix(name) % np.uint64(tables.groups)).astype(np.int64)
    key = group * len(words.languages) + words.lang[leaf]
    order = np.argsort(key, kind="stable")
    leaf, reach, counts, deep, key = leaf[order], reach[order], counts[order], deep[order], key[order]
    last = leaf + reach - 1
    size = words.offset[last] + words.length[last] + 1 - words.offset[leaf]
    ends = np.cumsum(size)
    text = words.joined[np.arange(ends[-1]) + np.repeat(words.offset[leaf] - (ends - size), size)]
    text[ends - 1] = 0x0A
    cuts = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:]):
        packed = counts[a:b].astype("<i4").tobytes() + deep[a:b].tobytes() + text[ends[a] - size[a] : ends[b - 1]].tobytes()
        lang = words.languages[key[a] % len(words.languages)]
        yield int(key[a] // len(words.languages)), lang, b - a, len(packed), pa.compress(packed, "zstd", asbytes=True)


class _Subtree:
    """The nodes of a group, or of a part of it, read from its sorted suffixes."""

    def __init__(self, blocks: list[tuple[int, int, bytes]]):
        counts, deep, texts = [], [], []
        for n, size, data in blocks:
            plain = pa.decompress(data, size, "zstd", asbytes=True)
            counts.append(np.frombuffer(plain, "<i4", n))
            deep.append(np.frombuffer(plain, np.uint8, n, 4 * n))
            texts.append(plain[5 * n :])
        self.text = b"".join(texts)
        raw = np.frombuffer(self.text, np.uint8)
        line = raw == 0x0A
        data = np.where(line, np.uint8(0x20), raw)
        ends = np.flatnonzero(data == 0x20) + 1
        coded = _encoded(data, np.append(0, ends))
        ids = coded.indices.to_numpy().astype(np.int64) + 1
        final = np.flatnonzero(line[ends - 1])
        first = np.append(0, final[:-1] + 1)
        words = final - first + 1
        columns = [np.where(words > d, ids[np.minimum(first + d, len(ids) - 1)], 0) for d in range(LONGEST)]
        base = len(coded.dictionary) + 1
        order = np.lexsort((columns[2] * base + columns[3], columns[0] * base + columns[1]))
        self.columns = [c[order] for c in columns]
        self.counts = np.concatenate(counts).astype(np.int64)[order]
        self.deep = np.concatenate(deep)[order]
        self.begin, self.first, self.ends = np.append(0, ends[final[:-1]])[order], first[order], ends

    def nodes(self, least: int, whole: bool) -> Iterator[tuple[str, int]]:
        """Phrases with their counts; those below ``least`` only where other parts may add to them."""
        new = np.zeros(len(self.counts), bool)
        new[0] = True
        for d, column in enumerate(self.columns, 1):
            new[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(self.counts, starts)
            settled = whole & (self.deep[starts] <= d)
            kept = np.flatnonzero((column[starts] > 0) & ((sums >= least) | ~settled))
            for at, n in zip(starts[kept].tolist(), sums[kept].tolist()):
                stop = self.ends[self.first[at] + d - 1] - 1
                yield self.text[self.begin[at] : stop].decode(), n


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, budget: int = BUDGET
) -> tuple[DataFrame, dict[str, int]]:
    """All phrases of up to LONGEST words that occur at least ``least`` times in their language, with their
    counts (__lang, __phrase, __f), stored; and the number of words of each language.

    A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs. A null text has no
    words, a null language counts as ``und``. Repeated rows count each time; other columns are not read.
    """
    frame = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("__lang"), F.col(text_col).alias("__text"))
    frame = frame.where("__text IS NOT NULL")
    tables = _Tables(_counted(frame, least), least, budget)
    shared = frame.sparkSession.sparkContext.broadcast(tables)  # bitmaps, of fixed size
    names = ["group", "lang", "leaves", "size", "packed"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()])))

    def suffixes(batches):
        for batch in batches:
            for slice_ in _slices(batch):
                words = _Words(*slice_)
                rows = list(_suffix_blocks(words, shared.value)) if words.count else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def subtrees(batches):
        held, key, leaves, cut = [], None, 0, False

        def read(whole):
            found = list(_Subtree(held).nodes(least, whole))
            for at in range(0, len(found), 10_000):
                phrases, counts = zip(*found[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(phrases)), pa.array(phrases), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["group"], row["lang"])
                if held and (here != key or leaves + row["leaves"] > budget):
                    cut = cut or here == key
                    yield from read(not cut)
                    held, leaves = [], 0
                cut = cut and here == key
                key = here
                held.append((row["leaves"], row["size"], row["packed"]))
                leaves += row["leaves"]
        if held:
            yield from read(not cut)

    blocks = frame.mapInArrow(suffixes, "group int, lang string, leaves int, size bigint, packed binary")
    dealt = blocks.repartition(tables.groups, "group").sortWithinPartitions("group", "lang")
    nodes = dealt.mapInArrow(subtrees, "lang string, phrase string, n bigint")
    summed = nodes.groupBy(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase")).agg(F.sum("n").alias("__f"))
    found = stored(summed.where(F.col("__f") >= least), "phrases")
    return found, tables.n


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; no task ranks more than about RANKED rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = -(-rows.count() // RANKED)
    while parts > 1:
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
        parts = -(-parts * top // RANKED) if parts * top > RANKED else 1
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET
) -> DataFrame:
    """The ``top`` phrases of 2 to LONGEST words of each language by how firmly their words belong together.

    Columns lang, rank, phrase, a (its occurrences), l and r (those of its parts at the cut that holds it
    together least), n (all words of the language) and score = floor(SCALE * a / (l + r)), worked out in
    decimals. Ties of cuts go to the shortest first part, ties of phrases to the larger a, then to the phrase
    first by UTF-8 bytes. A phrase inside a longer one with at least COVER hundredths of its occurrences is
    dropped, whether that one stays or not. No documents, or none with such a phrase, give no rows.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, least, budget)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("__phrase", " ")
    long_ = found.withColumn("__words", words).withColumn("__size", F.size(words)).where("__size > 1")

    def part(first, size):
        return F.array_join(F.slice("__words", first, size), " ")

    cuts = long_.select(
        F.col("__lang").alias("lang"), F.col("__phrase").alias("phrase"), F.col("__f").alias("a"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("__size") - 1), lambda k: F.struct(
            k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("__size") - k).alias("tail")))).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    heads = found.select(F.col("__lang").alias("lang"), F.col("__phrase").alias("head"), F.col("__f").alias("l"))
    tails = found.select(F.col("__lang").alias("lang"), F.col("__phrase").alias("tail"), F.col("__f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    met = met.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = long_.where("__size > 2").select(
        F.col("__lang").alias("lang"), F.col("__f").alias("around"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("__size") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("__size") - size + 1), lambda first: part(first, size))))).alias("phrase"),
    )
    covers = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (exact("around") * 100 < exact("a") * COVER)
    )
    kept = stored(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "scored")
    n = F.lit(None).cast("long")
    if totals:
        n = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("lang")).cast("long")
    return _ranked(kept, top).select("lang", "rank", "phrase", "a", "l", "r", n.alias("n"), "score")


def op11_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(p[1 : cut], ' ') AS head, array_to_string(p[cut + 1 : k], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, a, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, f, array_to_string(p[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, k, p, size, unnest(generate_series(1, k - size + 1)) AS i
        FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(generate_series(2, k - 1)) AS size FROM f WHERE k > 2))),
covers AS (SELECT lang, phrase, max(f) AS around FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN covers c ON c.lang = s.lang AND c.phrase = s.phrase
         WHERE c.around IS NULL OR 100::HUGEINT * c.around < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang)
QUALIFY rank <= 2000
"""
