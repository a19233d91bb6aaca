"""Language identification by prediction by partial matching.

For every language the bytes that follow each context of up to ``order`` bytes are counted in a
bounded sample. A byte costs what the longest seen context gives it; a context that has not seen it
pays its escape probability (as many escape counts as it has seen different bytes) and passes on to
the next shorter one, without the bytes already ruled out. The counts are frozen, so the code length
of a text is a sum over its (order + 1)-grams, and the language with the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import table
from reportlake.llm.textmap import slices, text_bytes

#: Bytes of the longest context.
ORDER = 4
#: Different texts of each language that are expected in the training sample.
SAMPLE = 1500
#: Slots of a worker's table of known grams, as a power of two; as many lie beside it at most.
SLOTS_BITS = 17
UNKNOWN = "und"

_CODES = np.arange(256)
_KEPT = ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
#: Digits, marks and white space say nothing about the language: all of them count as a space.
_PLAIN = np.where(_KEPT, _CODES, 32).astype(np.uint8)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte, as a number, and where each text begins.

    Before a text there are spaces, and runs of spaces count as one.
    """
    raw, ends = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    plain = _PLAIN[raw]
    space = plain == 32
    again = np.zeros(len(plain), bool)
    again[1:] = space[1:] & space[:-1]
    first = ends[:-1][ends[:-1] < len(plain)]
    again[first] = space[first]
    keep = ~again
    bounds = np.concatenate([[0], np.cumsum(keep)])[ends]
    plain = plain[keep]
    lengths = np.diff(bounds)
    gram = plain.astype(np.uint64)
    place = np.arange(len(plain)) - np.repeat(bounds[:-1], lengths)
    for back in range(1, order + 1):
        earlier = np.full(len(plain), 32, np.uint64)
        earlier[back:] = plain[:-back] if back < len(plain) else plain[:0]
        earlier[place < back] = 32
        gram |= earlier << np.uint64(8 * back)
    return gram, bounds


class Model:
    """Frozen counts of all languages. ``grams`` and ``counts``: per language, sorted, of full length."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray], order: int):
        self.languages, self.order = languages, order
        self.levels = [self._levels(g, c) for g, c in zip(grams, counts)]

    def _levels(self, grams: np.ndarray, counts: np.ndarray) -> list[dict]:
        """Per context length: its grams with counts, its contexts with totals and kinds."""
        levels = []
        for length in range(self.order + 1):
            mask = np.uint64((1 << 8 * (length + 1)) - 1)
            keys, where = np.unique(grams & mask, return_inverse=True)
            n = np.bincount(where, weights=counts, minlength=len(keys))
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            level = {
                "grams": keys, "n": n, "contexts": contexts,
                "total": np.bincount(owner, weights=n, minlength=len(contexts)),
                "kinds": np.bincount(owner, minlength=len(contexts)).astype(float),
            }
            if length:
                # a byte seen here was seen in the shorter context, where it is then ruled out
                short = levels[-1]
                ruled = short["n"][np.searchsorted(short["grams"], keys & np.uint64((1 << 8 * length) - 1))]
                level["ruled"] = np.bincount(owner, weights=ruled, minlength=len(contexts))
            levels.append(level)
        return levels

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of every gram, a column per language."""
        return np.stack([self._bits(levels, grams) for levels in self.levels], axis=1).astype(np.float32)

    def _bits(self, levels: list[dict], grams: np.ndarray) -> np.ndarray:
        cost = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        ruled_n, ruled_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for length in range(self.order, -1, -1):
            level = levels[length]
            if not len(level["grams"]):
                continue
            part = grams & np.uint64((1 << 8 * (length + 1)) - 1)
            context = part >> np.uint64(8)
            c = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
            seen = open_ & (level["contexts"][c] == context)
            g = np.minimum(np.searchsorted(level["grams"], part), len(level["grams"]) - 1)
            hit = seen & (level["grams"][g] == part)
            total = level["total"][c] - ruled_n
            kinds = level["kinds"][c] - ruled_kinds
            whole = np.maximum(total + kinds, 1)
            cost += np.where(hit, np.log2(whole) - np.log2(np.maximum(level["n"][g], 1)), 0)
            # with nothing left to rule out the escape is certain and free
            leave = seen & ~hit & (kinds > 0)
            cost += np.where(leave, np.log2(whole) - np.log2(np.maximum(kinds, 1)), 0)
            open_ &= ~hit
            if length:
                ruled_n = np.where(seen, level["ruled"][c], 0.0)
                ruled_kinds = np.where(seen, level["kinds"][c], 0.0)
            else:
                ruled_kinds = np.where(seen, level["kinds"][c], 0.0)
        return cost + np.where(open_, np.log2(np.maximum(256 - ruled_kinds, 1)), 0)


class _Known:
    """Code lengths of grams already met, in a table addressed by a hash of the gram.

    Grams whose slot is taken are kept sorted beside it, up to as many; then that list begins again.
    """

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << SLOTS_BITS, np.uint64(2**64 - 1))
        self.values = np.zeros((1 << SLOTS_BITS, len(model.languages)), np.float32)
        self.rest = np.zeros(0, np.uint64)
        self.rest_values = np.zeros((0, len(model.languages)), np.float32)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams * _SPREAD) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != grams)
        if not len(missed):
            return out
        kinds, where = np.unique(grams[missed], return_inverse=True)
        values = np.empty((len(kinds), out.shape[1]), np.float32)
        at = np.searchsorted(self.rest, kinds)
        old = np.zeros(len(kinds), bool)
        if len(self.rest):
            old = self.rest[np.minimum(at, len(self.rest) - 1)] == kinds
            values[old] = self.rest_values[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            values[new] = self.model.bits(kinds[new])
            own = ((kinds[new] * _SPREAD) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
            free = np.flatnonzero(self.keys[own] == np.uint64(2**64 - 1))
            _, once = np.unique(own[free], return_index=True)
            put = free[once]
            self.keys[own[put]], self.values[own[put]] = kinds[new[put]], values[new[put]]
            left = np.setdiff1d(np.arange(len(new)), put)
            if len(left):
                keys = np.concatenate([self.rest, kinds[new[left]]])
                all_values = np.concatenate([self.rest_values, values[new[left]]])
                if len(keys) > 1 << SLOTS_BITS:
                    keys, all_values = keys[:0], all_values[:0]
                order = np.argsort(keys)
                self.rest, self.rest_values = keys[order], all_values[order]
        out[missed] = values[where]
        return out


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample: int = SAMPLE
) -> Model:
    """A model from about ``sample`` different texts of each language, from all if there are no more.

    The sample is drawn by a hash of the text, so it does not depend on the order of rows, and a text
    counts once however often it is repeated. Rows with a null text or language are not used. Grams are
    counted where the documents are; the driver gets one row per language and gram of the sample, whose
    size the parameter bounds.
    """
    hashed = F.xxhash64(F.col(text_col), F.lit("sample"))
    own = docs.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), hashed.alias("__hash"))
    own = own.where("__lang IS NOT NULL AND __text IS NOT NULL")
    # one number per language; the model holds each of them anyway
    sizes = {r["__lang"]: r["count"] for r in own.select("__lang", "__hash").distinct().groupBy("__lang").count().collect()}
    if not sizes:
        return Model([], [], [], order)
    texts_of = F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair])
    drawn = F.shiftrightunsigned("__hash", 11) / F.lit(float(1 << 53))
    chosen = own.where(drawn * F.element_at(texts_of, F.col("__lang")) < sample)
    # copies meet before the shuffle
    chosen = chosen.groupBy("__lang", "__hash").agg(F.min("__text").alias("__text")).select("__lang", "__text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                langs, which = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
                gram, bounds = _grams(part.column(1), order)
                owner = np.repeat(which, np.diff(bounds))
                for i, lang in enumerate(langs):
                    keys, n = np.unique(gram[owner == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    rows = (
        chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ).toArrow()
    table_ = rows.sort_by([("lang", "ascending"), ("gram", "ascending")])
    names = np.array(table_.column(0).to_pylist(), dtype=object)
    grams = table_.column(1).to_numpy().view(np.uint64)
    counts = table_.column(2).to_numpy().astype(float)
    languages = sorted(set(names.tolist()))
    return Model(languages, [grams[names == x] for x in languages], [counts[names == x] for x in languages], order)


def _judge(part: pa.RecordBatch, column: int, model: Model, known: _Known | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: index of the language (one past the last: und), score, bits a byte."""
    texts = part.column(column)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    gram, bounds = _grams(texts, model.order)
    lengths = np.diff(bounds)
    best = np.full(part.num_rows, len(model.languages))
    score, mean = np.zeros(part.num_rows), np.zeros(part.num_rows)
    full = np.flatnonzero(lengths > 0)
    use = np.flatnonzero((lengths > 0) & lettered)
    if known is not None and len(use):
        total = np.add.reduceat(known.bits(gram), bounds[full], axis=0, dtype=np.float64)
        each = total[np.searchsorted(full, use)] / lengths[use, None]
        best[use] = each.argmin(axis=1)
        mean[use] = each.min(axis=1)
        score[use] = 1 / np.exp2(32 * (mean[use, None] - each)).sum(axis=1)
    return best, score, mean


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score and bits_per_byte.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if the model
    has no language. The score is the share of the winner when each language weighs
    2 ** (32 x mean bits a byte it saves); ties go to the language first by name. Whole texts are
    read; rows, repeated or not, are judged one by one; other columns are not read.
    """
    frame = docs.select(id_col, text_col)

    def run(batches):
        known = _Known(model) if model.languages else None
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, text_col):
                best, score, mean = _judge(part, 1, model, known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(mean)],
                    [id_col, "lang_pred", "score", "bits_per_byte"],
                )

    id_type = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double, bits_per_byte double")


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns as they are, whose text is in one of the learned languages."""
    at = docs.columns.index(text_col)

    def run(batches):
        known = _Known(model) if model.languages else None
        for batch in batches:
            for part in slices(batch, text_col):
                best, _, _ = _judge(part, at, model, known)
                yield part.filter(pa.array(best < len(model.languages)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def op8_partial_matching(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
