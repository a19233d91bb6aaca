"""Batches of texts as numpy arrays, for operators that run per document in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about so many bytes, which bounds what numpy allocates.
SLICE_BYTES = 1 << 20

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
IS_WORD = ((_CODES >= 48) & (_CODES <= 57)) | _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
#: Odd 64-bit constants; the powers and byte values make up the polynomial word hash.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_VALUES = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def slices(batch: pa.RecordBatch, column: str, beside: int = 64) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text, a longer text alone.

    ``beside`` is what a text counts beside its length, which bounds the texts of a piece.
    """
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes + beside) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _MIX | np.uint64(1), dtype=np.uint64))


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (0-9, a-z, beyond ASCII; A-Z lower-cased), and where each text's begin."""
    inside = IS_WORD[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    letters = np.flatnonzero(inside)
    first = np.searchsorted(letters, starts)
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = _VALUES[LOWER[raw[letters]]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first)), np.searchsorted(starts, ends)


def joined_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text; a shorter text with words is one run."""
    counts = np.diff(bounds)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], runs)
    last = np.repeat(bounds[1:], runs)
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        here = at + i
        ok = here < last
        word = np.where(ok, hashes[np.minimum(here, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else total
        total = mix(total * _MIX + word + np.uint64(i + 1))
    return total, out_bounds
