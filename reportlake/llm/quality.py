"""Quality classification by nearest-neighbour voting in a latent semantic space.

A bounded labelled sample gives a term weighting, a latent semantic projection and labelled vectors;
these are broadcast. Every document is projected, compared with all labelled vectors in blocks of
exact cosine products, and takes the labels of its nearest neighbours weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import table
from reportlake.llm.textmap import SLICE_BYTES, slices, text_bytes, word_hashes

#: Labelled documents of each label that train at most.
SAMPLE = 2000
#: Terms: hashed words, bytes that occur, repeated and capital words by share, lengths.
WORD_TERMS = 1024
SHAPES = 12
TERMS = WORD_TERMS + 256 + SHAPES
DIMENSIONS = 64
NEIGHBOURS = 25
#: Similarity counts by this power.
SHARPNESS = 8
#: Rows of one block of cosine products.
BLOCK = 256
THRESHOLD = 0.3
#: Bytes a text counts beside its length: at most 1024 texts are counted at a time.
BESIDE = SLICE_BYTES >> 10

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = (_CODES >= 97) & (_CODES <= 122)


def _counts(column: pa.Array) -> np.ndarray:
    """Term weights before scaling: a row per text."""
    raw, ends = text_bytes(column)
    rows = len(ends) - 1
    sizes = np.diff(ends)
    hashes, bounds = word_hashes(raw, ends)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(rows), n_words)
    words = np.bincount(
        owner * WORD_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64), minlength=rows * WORD_TERMS
    ).reshape(rows, WORD_TERMS)
    of = np.repeat(np.arange(rows), sizes)
    marks = np.bincount(of * 256 + raw, minlength=rows * 256).reshape(rows, 256)
    repeated = np.zeros(rows)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        repeated = np.bincount(owner[1:][same], minlength=rows)
    order = np.lexsort((hashes, owner))
    kinds = np.zeros(rows)
    if len(hashes):
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        kinds = np.bincount(o[new], minlength=rows)
    upper, lower = marks[:, _UPPER].sum(axis=1), marks[:, _LOWER].sum(axis=1)
    letters = np.maximum(upper + lower + marks[:, 128:].sum(axis=1), 1)
    total, many = np.maximum(sizes, 1), np.maximum(n_words, 1)
    shares = [repeated / many, 1 - kinds / many, upper / letters, 1 - letters / total, many / total]
    # each share as a soft pair, lengths as two ends of a scale
    length = np.clip(np.log2(sizes + 1) / 16, 0, 1)
    shapes = np.stack([x for s in shares for x in (np.sqrt(np.clip(s, 0, 1)), 1 - np.sqrt(np.clip(s, 0, 1)))] + [length, 1 - length], axis=1)
    scaled = np.sqrt(words / many[:, None]), np.sqrt(marks / total[:, None])
    return np.concatenate([*scaled, shapes], axis=1).astype(np.float32)


@dataclass
class Model:
    """Everything of a size that the parameters bound."""

    mean: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = ((counts - self.mean) * self.weight) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), BLOCK):
            cosine = self.project(counts[a : a + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS + 1e-9
            out[a : a + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Term weighting and projection by a randomised singular value decomposition (fixed seed)."""
    labels = labels.astype(float)
    if not len(labels):
        empty = np.zeros((0, dimensions), np.float32)
        return Model(np.zeros(TERMS, np.float32), np.ones(TERMS, np.float32), np.zeros((TERMS, dimensions), np.float32), empty, labels, 0.5)
    mean = counts.mean(axis=0)
    # inverse document frequency for words and bytes
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    idf[WORD_TERMS + 256 :] = 1.0
    weight = idf.astype(np.float32)
    x = (counts - mean) * weight
    k = min(dimensions, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ right.T)[:, :k].astype(np.float32)
    model = Model(mean, weight, basis, np.zeros((0, k), np.float32), labels, float(labels.mean()))
    model.vectors = model.project(counts).astype(np.float32)
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Model:
    """A model from at most ``sample`` labelled documents of each label 0 and 1, chosen by a hash of the id.

    As many of either label make the vote independent of how common a label is. Null labels, ids or
    texts are not used; an id labelled twice is used once for each label it has, an id on several rows
    once, with the text of least hash. The driver gets one vector of fixed size for each chosen id.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(
        "__id IS NOT NULL AND __label IN (0, 1)"
    )
    drawn = [
        known.where(F.col("__label") == v).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample) for v in (0, 1)
    ]
    ids = drawn[0].unionByName(drawn[1])
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    one = F.min(F.struct(F.xxhash64("__text").alias("hash"), F.col("__text").alias("text")))
    chosen = chosen.join(F.broadcast(ids), "__id").groupBy("__id", "__label").agg(one.alias("__one")).select("__label", F.col("__one.text").alias("__text"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "__text", BESIDE):
                rows = [row.tobytes() for row in _counts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["label", "terms"])

    rows = chosen.mapInArrow(count, "label int, terms binary").toArrow().to_pydict()
    order = sorted(range(len(rows["label"])), key=lambda i: (rows["label"][i], rows["terms"][i]))
    terms = np.frombuffer(b"".join(rows["terms"][i] for i in order), dtype=np.float32).reshape(len(order), TERMS)
    return fit(terms, np.array([rows["label"][i] for i in order], dtype=float))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score, the weighted share of label 1 among the nearest labelled documents.

    Whole texts are read; null counts as empty, and an empty text is scored like any other by its
    length and shares. Equal texts get equal scores. Without labelled documents every score is 0.5.
    """
    frame = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, BESIDE):
                score = model.score(_counts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], [id_col, "score"])

    return frame.mapInArrow(run, f"`{id_col}` {frame.schema[id_col].dataType.simpleString()}, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def op1_neighbour_voting(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return classify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
