from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import ODD

from reportlake.llm import phrases

PLAIN = {i: i + 32 for i in range(65, 91)}


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(PLAIN)):
        yield [w for w in re.split("[ \t]", piece) if w]


def plain(docs, least, top):
    """Collocations from one count of all phrases in memory."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for words in pieces_of(text):
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, f in counts.items():
        rows, long_ = [], [(q, n) for q, n in f.items() if n >= least]
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            around = (
                q for q, n in long_
                if len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if next(around, None):
                continue
            score, k, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, totals[lang], -score)
    return out


def found(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["The", "of", "é", "日本", "x" * 40, "a\x01b", "a", "b", "to", " "]
    rows = []
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", "\n"]) for w in words)))
    rows += [("en", "New York City hall ") for _ in range(40)] + [("en", t) for t in ODD]
    return rows


@pytest.mark.parametrize("budget, groups", [(300, 1000), (60, 3), (1 << 19, 1000)])
def test_equals_one_count(spark, texts, budget, groups, monkeypatch):
    """Groups of any size, and groups taken in several parts, give the same counts."""
    monkeypatch.setattr(phrases, "GROUPS", groups)
    docs = spark.createDataFrame(texts, "lang string, text string").selectExpr("*", "1 AS n", "'p' AS phrase", "'x' AS `__lang`").repartition(5)
    got = found(phrases.collocations(docs, least=5, top=40, budget=budget))
    assert got == plain(texts, 5, 40)
    assert len(got) > 60


def test_parts_of_a_long_text(spark, monkeypatch):
    """A text beyond a slice is read whole wherever it is cut: at breaks, at blanks, or inside no word."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", 50)
    rng = random.Random(4)
    for seps in ([" "], [" ", ". "], ["\t", " \n"]):
        text = "".join(rng.choice(["a", "bb", "é", "w" * 200]) + rng.choice(seps) for _ in range(400))
        starts = Counter()
        for part, own in phrases._parts(text.encode()):
            words = phrases._Words([part], [own], ["en"])
            if not words.count:
                continue
            reach = phrases._reach(words.next)
            raw = words.joined.tobytes()
            for i in range(words.count):
                if words.own[i]:
                    last = i + reach[i] - 1
                    starts[raw[words.offset[i] : words.offset[last] + words.length[last]].decode()] += 1
        want = Counter(" ".join(p[i : i + 4]) for p in pieces_of(text) for i in range(len(p)))
        assert starts == want


def test_ranks_in_parts(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "lang string, text string")
    monkeypatch.setattr(phrases, "RANKED", 30)
    assert found(phrases.collocations(docs, least=5, top=7)) == plain(texts, 5, 7)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    rows = phrases.collocations(docs)
    assert rows.count() == 0 and rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b")], docs.schema)).count() == 0
