"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest piece at each place. The automaton is a trie over the vocabulary
in which every node knows where to go on when no child fits (its failure link) and how many pieces
are finished on the way there. Each character is read once and no piece is ever built.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from reportlake.llm.common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the begin of a word in the vocabulary.
MARK = "▁"
#: Words whose count a worker remembers; when full, it starts afresh.
REMEMBERED = 300_000


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of a vocabulary file, read on the driver; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [
        model.id_to_piece(i)
        for i in ids
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Automaton:
    """Pieces with MARK begin a word; the others continue one.

    ``children[v]`` maps characters to nodes, ``link[v]`` is the failure link (-1: no way on) and
    ``done[v]`` the number of pieces finished by following it.
    """

    def __init__(self, pieces: list[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.begin, self.inside = 0, 1
        ends = {}
        for piece in pieces:
            node = self.begin if piece.startswith(MARK) else self.inside
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            if piece:
                ends[node] = True
        self.link, self.done = [-1] * len(self.children), [0] * len(self.children)
        level = [self.begin, self.inside]
        while level:
            below = []
            for node in level:
                for c, child in self.children[node].items():
                    below.append(child)
                    if child in ends:
                        self.link[child], self.done[child] = self.inside, 1
                        continue
                    at, finished = self.link[node], self.done[node]
                    while at >= 0 and c not in self.children[at]:
                        finished += self.done[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.done[child] = self.children[at][c], finished
            level = below

    def count(self, word: str) -> int:
        """Pieces of one word, 0 if greedy matching cannot finish it."""
        children, link, done = self.children, self.link, self.done
        node, total = self.begin, 0
        for c in MARK + word:
            while c not in children[node]:
                total += done[node]
                node = link[node]
                if node < 0:
                    return 0
            node = children[node][c]
        while node != self.inside:
            total += done[node]
            node = link[node]
            if node < 0:
                return 0
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.automaton.count(word)
        return found


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens, n_unknown.

    Words are what white space separates. A word that the vocabulary cannot spell counts as one
    token and one unknown. Null and empty texts have no words. Rows, repeated or not, are counted
    one by one; only id and text are read. The vocabulary travels to the workers with the function;
    it has a fixed size.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = _Counts(Automaton(pieces))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                split = (text.as_py() or "").split()
                found = [counts[w] for w in split]
                missed = found.count(0)
                words.append(len(split))
                tokens.append(sum(found) + missed)
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                [id_col, "n_words", "n_tokens", "n_unknown"],
            )

    schema = f"`{id_col}` {id_type}, n_words bigint, n_tokens bigint, n_unknown bigint"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())
