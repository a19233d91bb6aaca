"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads the text once. At each position the output links
name every piece that ends there, and each relaxes the best score of that position; the best path
back from the end is the encoding. The texts of a slice are cut where no piece can reach across, and
all their different segments go through the automaton together, a character of each at a time; nothing
is remembered between slices. Decoding joins the pieces' bytes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from reportlake.llm.common import table
from reportlake.llm.textmap import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Characters that are searched at a time; the arrays of a search take about 100 bytes for each.
PART = 1 << 20
#: So many of the longest segments are searched one by one.
FEW = 48
_CUT = re.compile(f"[^{SPACE}]{SPACE}")


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says, read on the driver; of fixed size."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    unknown: int
    byte_ids: tuple[int, ...]


def read_model(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
    pieces = tuple(model.id_to_piece(i) for i in ids)
    where = {p: i for i, p in enumerate(pieces) if model.is_byte(i)}
    return Vocabulary(
        pieces,
        tuple(model.get_score(i) for i in ids),
        tuple(not x for x in special),
        model.unk_id(),
        tuple(where[f"<0x{b:02X}>"] for b in range(256)) if len(where) == 256 else (),
    )


class Encoder:
    """The automaton in flat arrays, and the search over all different segments of some texts at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        usable = [(p, i) for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable)) if ok and p]
        #: Where a node and a character lead, by (node << 21) + character.
        self.goto: dict[int, int] = {}
        piece, depth = [-1], [0]
        for text, i in usable:
            node = 0
            for c in text:
                key = (node << 21) + ord(c)
                if key not in self.goto:
                    self.goto[key] = len(piece)
                    piece.append(-1)
                    depth.append(depth[node] + 1)
                node = self.goto[key]
            piece[node] = i
        edges = sorted((depth[child], key, child) for key, child in self.goto.items())
        self.fail = [0] * len(piece)
        #: The nearest node on the failure path, the node itself first, that ends a piece; and the one after it.
        self.first, self.link = [0] * len(piece), [0] * len(piece)
        for _, key, child in edges:  # shorter ones first
            node, c = key >> 21, key & 0x1FFFFF
            at = self.fail[node]
            while at and (at << 21) + c not in self.goto:
                at = self.fail[at]
            self.fail[child] = self.goto.get((at << 21) + c, 0) if node else 0
            self.link[child] = self.first[self.fail[child]]
            self.first[child] = child if piece[child] >= 0 else self.link[child]
        self.depth, self.piece = depth, piece
        self.score = [vocabulary.scores[i] if i >= 0 else 0.0 for i in piece]
        self.unknown_score = min((vocabulary.scores[i] for _, i in usable), default=0.0) - UNKNOWN_PENALTY
        long_pieces = [p for p, _ in usable if len(p) > 1]
        self.cuttable = bool(vocabulary.byte_ids) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long_pieces)
        #: Characters that longer pieces hold, the mark aside.
        self.inner = np.zeros(0x110000, bool)
        self.inner[[ord(c) for p in long_pieces for c in p if c != SPACE]] = True
        keys = np.array(sorted(self.goto) or [0], np.int64)
        self.keys, self.to = keys, np.array([self.goto.get(k, 0) for k in keys.tolist()], np.int64)
        self.fails, self.firsts, self.links = (np.array(x, np.int64) for x in (self.fail, self.first, self.link))
        self.depths, self.scores, self.pieces = np.array(depth, np.int64), np.array(self.score), np.array(piece, np.int64)

    def best(self, text: str) -> list[int]:
        """The ids of the best path through one segment, by one pass over its characters."""
        goto, fail, first, link = self.goto, self.fail, self.first, self.link
        depth, scores, pieces, unknown = self.depth, self.score, self.piece, self.unknown_score
        n = len(text)
        top, back, taken = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        node = end = 0
        for c in map(ord, text):
            end += 1
            child = goto.get((node << 21) + c)
            while child is None and node:
                node = fail[node]
                child = goto.get((node << 21) + c)
            node = child or 0
            best, start, chosen, length = None, end - 1, -1, 0
            # on a tie the longer piece, which comes first, stays
            at = first[node]
            while at:
                length = depth[at]
                score = top[end - length] + scores[at]
                if best is None or score > best:
                    best, start, chosen = score, end - length, pieces[at]
                at = link[at]
            if length != 1:  # no piece of one character
                score = top[end - 1] + unknown
                if best is None or score > best:
                    best, start, chosen = score, end - 1, -1
            top[end], back[end], taken[end] = best, start, chosen
        path, end = [], n
        while end:
            path.append((back[end], end, taken[end]))
            end = back[end]
        ids: list[int] = []
        for start, end, i in reversed(path):
            if i >= 0:
                ids.append(i)
            elif self.v.byte_ids:
                ids.extend(self.v.byte_ids[b] for b in text[start:end].encode())
            elif not ids or ids[-1] != self.v.unknown:
                ids.append(self.v.unknown)
        return ids

    def _follow(self, node: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The automaton's next nodes."""
        out = np.zeros(len(node), np.int64)
        left = np.arange(len(node))
        while len(left):
            key = (node[left] << 21) + chars[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[left[hit]] = self.to[at[hit]]
            left = left[~hit & (node[left] > 0)]
            node[left] = self.fails[node[left]]
        return out

    def _search(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many segments, the longest first: all ids in order, and how many each has.

        The pass goes over the first characters of all segments, then over the second ones, and so on.
        """
        m = len(lengths)
        offset = np.cumsum(lengths + 1) - (lengths + 1)
        top = np.zeros(int((lengths + 1).sum()))
        step, taken = np.ones(len(top), np.int64), np.full(len(top), -1, np.int64)
        node = np.zeros(m, np.int64)
        reach = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
        for t, k in enumerate(reach.tolist()):
            node = self._follow(node[:k].copy(), chars[starts[:k] + t])
            end = offset[:k] + t + 1
            best, size, chosen = np.full(k, -np.inf), np.ones(k, np.int64), np.full(k, -1, np.int64)
            single = np.zeros(k, bool)
            rows, at = np.arange(k), self.firsts[node]
            while True:
                some = at > 0
                rows, at = rows[some], at[some]
                if not len(rows):
                    break
                length = self.depths[at]
                score = top[end[rows] - length] + self.scores[at]
                better = score > best[rows]
                up = rows[better]
                best[up], size[up], chosen[up] = score[better], length[better], self.pieces[at[better]]
                single[rows] = length == 1
                at = self.links[at]
            score = top[end - 1] + self.unknown_score
            better = ~single & (score > best)
            best[better], size[better], chosen[better] = score[better], 1, -1
            top[end], step[end], taken[end] = best, size, chosen
        found, rows, at = [], np.arange(m), lengths.copy()
        while len(rows):
            here = offset[rows] + at
            ids = taken[here]
            lost = ids < 0
            ids[lost] = -1 - chars[starts[rows[lost]] + at[lost] - 1]
            found.append((rows, ids))
            at = at - step[here]
            rows, at = rows[at > 0], at[at > 0]
        rows, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rows[::-1], kind="stable")  # found from the end
        rows, ids = rows[::-1][order], ids[::-1][order]
        return self._bytes(rows, ids, m)

    def _bytes(self, rows: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters, given as -1 - character, become byte pieces."""
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            parts = [[self.v.byte_ids[b] for b in chr(-1 - c).encode()] for c in ids[lost].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = list(map(len, parts))
            ids[lost] = [p[0] for p in parts]
            ids, rows = np.repeat(ids, times), np.repeat(rows, times)
            at = (np.cumsum(times) - times)[lost]
            for k in (1, 2, 3):
                more = [i for i, p in enumerate(parts) if len(p) > k]
                ids[at[more] + k] = [parts[i][k] for i in more]
        return ids, np.bincount(rows, minlength=m)

    def _segments(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where segments begin: no piece reaches across, so the best path is that of each for itself."""
        mark = chars == ord(SPACE)
        alone = ~(mark | self.inner[chars])
        begins = alone.copy()
        begins[1:] |= alone[:-1] | (mark[1:] & ~mark[:-1])
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(begins)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one text's after the other's, and where each text's begin and end."""
        if not self.cuttable:  # unknown characters merge across segments
            whole = [self.best(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            return np.array([i for p in whole for i in p], "<i4"), np.cumsum([0, *map(len, whole)])
        counts, out, held, owners, size = np.zeros(len(texts), np.int64), [], [], [], 0
        for i, text in enumerate(texts):
            for part in _parts(SPACE + text.replace(" ", SPACE)) if text else ():
                if held and size + len(part) > PART:
                    out.append(self._encoded(held, owners, counts))
                    held, owners, size = [], [], 0
                held.append(part)
                owners.append(i)
                size += len(part)
        if held:
            out.append(self._encoded(held, owners, counts))
        return np.concatenate([np.zeros(0, "<i4"), *out]), np.append(0, np.cumsum(counts))

    def _encoded(self, marked: list[str], owners: list[int], counts: np.ndarray) -> np.ndarray:
        """The ids of texts or parts of texts whose spaces are marks; their numbers are added to ``counts``."""
        bounds = np.cumsum([0, *map(len, marked)])
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<i4").astype(np.int64)
        starts = self._segments(chars, bounds)
        cuts = np.append(starts, len(chars))
        data = pa.py_buffer(chars.astype("<i4"))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts * 4), data]).dictionary_encode()
        kind, kinds = coded.indices.to_numpy(), coded.dictionary
        own = np.frombuffer(kinds.buffers()[1], np.int64)[: len(kinds) + 1] // 4
        letters = np.frombuffer(kinds.buffers()[2], "<i4")[: own[-1]].astype(np.int64)
        order = np.argsort(-np.diff(own), kind="stable")
        length = np.diff(own)[order]
        few = int(np.searchsorted(-length, -int(length[min(FEW, len(length) - 1)]), side="left"))
        many, ids = np.zeros(len(kinds), np.int64), []
        for k in order[:few].tolist():  # the few longest, each for itself
            ids.append(np.array(self.best(letters[own[k] : own[k + 1]].astype("<i4").tobytes().decode("utf-32-le"))))
            many[k] = len(ids[-1])
        if few < len(order):
            rest, n = self._search(letters, own[:-1][order[few:]], length[few:])
            ids.append(rest)
            many[order[few:]] = n
        ids = np.concatenate(ids)
        first = np.zeros(len(kinds), np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        n = many[kind]
        ends = np.cumsum(n)
        np.add.at(counts, owners, np.diff(np.append(0, ends)[np.searchsorted(starts, bounds)]))
        return ids[np.arange(ends[-1]) + np.repeat(first[kind] - (ends - n), n)].astype("<i4")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return self.encode_all([text])[0].tobytes()


def _parts(marked: str):
    """A text whose spaces are marks, in parts of about PART characters, cut before a mark."""
    at = 0
    while len(marked) - at > PART:
        cut = _CUT.search(marked, at + PART)
        if not cut:
            break
        yield marked[at : cut.start() + 1]
        at = cut.start() + 1
    yield marked[at:]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        values = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        parts = [
            values.get(i, p.replace(SPACE, " ").encode() if ok else b"")
            for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable))
        ]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: the leading space that encoding adds is taken off."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0][1:]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of several texts, each with its leading space, and where each begins and ends."""
        length = self.length[ids]
        stops = np.append(0, np.cumsum(length))
        at = np.arange(stops[-1]) + np.repeat(self.start[ids] - stops[:-1], length)
        return self.blob[at].tobytes(), stops[ends]


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "piece_ids"
) -> DataFrame:
    """The rows with their ids (array<int>) added, or replaced if the column exists.

    A null text has null ids, an empty one an empty list; texts are encoded whole, each row for
    itself. A space is written as the vocabulary's mark and one is put before the text; nothing else
    is normalised, so decoding gives the text back where the model has byte pieces.
    """
    others = [c for c in docs.columns if c != ids_col]
    frame = docs.select(*others)
    at = others.index(text_col)

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = batch.column(at).to_pylist()
            found, ends = encoder.encode_all([t or "" for t in texts])
            starts = pa.array(ends, pa.int32(), mask=np.array([t is None for t in texts] + [False]))
            ids = pa.ListArray.from_arrays(starts, found)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*others, ids_col])

    return frame.mapInArrow(run, StructType([*frame.schema, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """The rows with the decoded text added or replaced; null ids give null."""
    others = [c for c in rows.columns if c != text_col]
    frame = rows.select(*others)
    at = others.index(ids_col)

    def run(batches):
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [
                None if ids is None else decoder.decode(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")
                for ids in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, text_col])

    return frame.mapInArrow(run, StructType([*frame.schema, StructField(text_col, StringType())]))


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip.

    Each text is encoded and decoded again in one pass; round_trip says whether it came back.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, ends = encoder.encode_all(texts)
            plain, cuts = decoder.decode_all(found, ends)
            coded = found.tobytes()
            sums = [hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
            same = [plain[a:b] == t.encode() for t, a, b in zip(texts, cuts[:-1] + (np.diff(cuts) > 0), cuts[1:])]
            counts = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums), pa.array(same, pa.bool_())],
                [id_col, "n_ids", "ids_sha256", "round_trip"],
            )

    schema = f"`{id_col}` {id_type}, n_ids bigint, ids_sha256 string, round_trip boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_pieces(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), read_model())
