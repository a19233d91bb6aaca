from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, prose
from pyspark.sql import functions as F

from reportlake.llm import decontaminate, exact_dedup, line_dedup, near_join, passage_dedup
from reportlake.llm.common import flags

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(vocabulary, seed, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, vocabulary, rng.randint(1, 60)) for _ in range(n)]
    texts += [t.upper() for t in texts[:3]] + [texts[0] + " ", "  " + texts[1], texts[2], texts[2]]
    for t in texts[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ODD + ODD[:3]
    return list(enumerate(texts)) + [(None, "no id"), (0, texts[0]), (3, "another text of the same id")]


# --- Exact dedup ---------------------------------------------------------------


def plain_classes(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), (doc is not None, doc or 0), i, doc))
    out = []
    for body, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(doc, best[3], len(members), i == best[2], digest) for _, _, i, doc in members]
    return out


@pytest.mark.parametrize("bound", [exact_dedup.BROADCAST_BYTES, 0])
def test_exact_classes(make, vocabulary, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bound)
    rows = corpus(vocabulary, 1)
    got = [tuple(r) for r in exact_dedup.classes(make(rows)).collect()]
    assert Counter(got) == Counter(plain_classes(rows))


@pytest.mark.parametrize("bound", [exact_dedup.BROADCAST_BYTES, 0])
def test_exact_rows_that_stay(make, vocabulary, monkeypatch, bound):
    """Where the filter has no room for all rows, it holds the repeated ones; texts it clears never move."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bound)
    rows = corpus(vocabulary, 2)
    docs = make(rows)
    left = exact_dedup.deduplicated(docs)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join LeftOuter") == 2
    assert left.columns == docs.columns
    kept = Counter(d for d, _, _, kept, _ in plain_classes(rows) if kept)
    assert Counter(r["doc_id"] for r in left.collect()) == kept


def test_bloom_filter_lets_single_rows_pass(make, vocabulary):
    rows = [(i, f"text number {i}") for i in range(3000)] + [(5000, "text number 7")]
    docs = make(rows)
    hashed = exact_dedup._hashed(docs, "doc_id", "text")
    blocks = exact_dedup.repeated_bits(hashed, "__sha", len(rows))
    maybe = exact_dedup.maybe_repeated(hashed, blocks, "__sha", len(rows)).where("__maybe")
    found = {r["__id"] for r in maybe.collect()}
    assert {7, 5000} <= found and len(found) < 0.05 * len(rows)


# --- Decontamination -----------------------------------------------------------


def plain_hits(rows, items, span=10):
    out = []
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            v = words(body)
            size = min(span, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names.add(item)
        listed = ",".join(sorted(map(str, names)))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, -1])
def test_decontamination(make, vocabulary, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    items = [(i, prose(rng, vocabulary, n)) for i, n in enumerate([30, 10, 11, 9, 5, 3, 1, 25, 40])]
    items += [(20, None), (21, "..."), (1, items[1][1]), (22, "same same same same same same same same same same same")]
    rows = corpus(vocabulary, 3, 20)
    for k, n in enumerate([9, 10, 11, 14, 30, 40]):
        v = items[k % 2 * 8][1].split()[:n]
        rows.append((100 + k, f"{prose(rng, vocabulary, 7)}. {' '.join(v).upper()}, {prose(rng, vocabulary, 5)}"))
    rows += [(200, items[4][1]), (201, "same " * 30), (202, ", ".join(items[7][1].split()) + "!"), (202, items[8][1])]
    benchmark = make(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.find_spans(make(rows), benchmark))
    assert Counter(map(tuple, got.collect())) == Counter(plain_hits(rows, items))
    left = decontaminate.without_contaminated(make(rows), benchmark)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, *_, bad in plain_hits(rows, items) if not bad)


def test_decontamination_with_empty_tables(make):
    none = make([], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.find_spans(make([(1, "a b")]), none).select("n_words", "spans", "items").collect()] == [(2, [], [])]
    assert decontaminate.find_spans(make([]), make([(1, "a b c")], "item_id bigint, text string")).count() == 0


def test_a_document_of_the_whole_benchmark_many_times(make, vocabulary):
    rng = random.Random(12)
    items = [(i, prose(rng, vocabulary, 40)) for i in range(30)] + [(100 + i, "shared by many items " * 4) for i in range(40)]
    whole = " ".join(t for _, t in items)
    rows = [(1, f"before {whole} after " * 40), (2, prose(rng, vocabulary, 50)), (1, f"before {whole} after " * 40)]
    benchmark = make(items, "item_id bigint, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.find_spans(make(rows), benchmark)).collect()}
    assert time.monotonic() - began < 90
    assert got[1]["n_items"] == 70 and got[1]["n_hit"] == got[1]["n_words"] - 80 and not got[2]["contaminated"]


def test_slots_let_every_asked_hash_pass(spark):
    frame = spark.createDataFrame([([0, 3, 4, 9],), ([],), ([5],)], "a array<int>").select(flags(F.col("a")).alias("f"))
    assert [bytes(r["f"]) for r in frame.collect()] == [b"1001100001", b"", b"000001"]


# --- Line dedup ----------------------------------------------------------------


def plain_lines(rows, run, long_line):
    """Every later window by comparing each with all before it."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, gone = set(), defaultdict(set)
    for i in order:
        lines = [" ".join(re.split(r"[\x09-\x0D\x20]+", x)).strip(" ") for x in (rows[i][1] or "").split("\n")]
        full = [(k, x) for k, x in enumerate(lines) if x]
        for p in range(len(full)):
            windows = [full[p : p + run]] if p + run <= len(full) else []
            if len(full[p][1].split(" ")) >= long_line:
                windows.append(full[p : p + 1])
            for w in windows:
                content = tuple(x for _, x in w)
                if content in seen:
                    gone[i] |= {k for k, _ in w}
                seen.add(content)
    out = []
    for i, (doc, text) in enumerate(rows):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        out.append((doc, kept, 0 if text is None else text.count("\n") + 1, len(gone[i]), tuple(sorted(gone[i]))))
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_repeated_runs(make, vocabulary, run):
    rng = random.Random(run)
    lines = [prose(rng, vocabulary, rng.randint(1, 6)) for _ in range(12)] + [prose(rng, vocabulary, 9), "", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(50)]
    rows += [(100, "same\nsame\nsame\nsame"), (101, "only\t one  line"), (102, "only one line")]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, "first\nlines\nhere"), (300, "first\nlines\nhere")]
    found = line_dedup.without_repeated_runs(make(rows), run=run, long_line=9)
    got = Counter((*r[:4], tuple(r["deleted"])) for r in found.collect())
    assert got == Counter(plain_lines(rows, run, 9))


def test_many_deleted_lines_take_linear_time(make):
    text = "\n".join(f"line number {i}" for i in range(100_000))
    began = time.monotonic()
    got = line_dedup.without_repeated_runs(make([(1, text), (2, text), (3, f"own\n{text}\nown")])).collect()
    assert time.monotonic() - began < 90
    assert {r["doc_id"]: (r["n_deleted"], r["text"]) for r in got} == {1: (0, text), 2: (100_000, ""), 3: (100_000, "own\nown")}


def test_line_dedup_of_nothing(make):
    assert line_dedup.without_repeated_runs(make([])).count() == 0


def test_copies_of_a_row_lose_their_runs(make):
    found = line_dedup.without_repeated_runs(make([(1, "a b\nc d")] * 3)).collect()
    assert sorted(r["n_deleted"] for r in found) == [0, 2, 2]


# --- Passage dedup -------------------------------------------------------------


def plain_passages(rows, span):
    """Every later window of words by comparing each with all before it."""
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        found = list(re.finditer(r"[^\x09-\x0D\x20]+", rows[i][1] or ""))
        w, gone = [m[0] for m in found], set()
        for p in range(len(w) - span + 1):
            if tuple(w[p : p + span]) in seen:
                gone |= set(range(p, p + span))
            seen.add(tuple(w[p : p + span]))
        marks = [0, *(m.start() for m in found), len(rows[i][1] or "")]
        text = (rows[i][1] or "")[: marks[1]] + "".join(rows[i][1][marks[k + 1] : marks[k + 2]] for k in range(len(w)) if k not in gone)
        out[i] = (rows[i][0], None if rows[i][1] is None else text, len(w), len(gone))
    return out


@pytest.mark.parametrize("span", [6, 7, 50])
def test_repeated_passages(make, vocabulary, span):
    rng = random.Random(span)
    shared = [prose(rng, vocabulary, rng.randint(span - 1, 3 * span)) for _ in range(6)]
    rows = []
    for i in range(60):  # passages in running text, that begin and end inside longer lines, whole or in part
        w = rng.choice(shared).split()
        a = rng.randrange(len(w))
        part = w[a:] if i % 3 == 0 else w[: a + 1] if i % 3 == 1 else w
        rows.append((i, f" {prose(rng, vocabulary, rng.randint(0, 20))}\n{rng.choice([' ', chr(9)]).join(part)} {prose(rng, vocabulary, 9)}"))
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, rows[5][1]), (300, rows[6][1]), (300, rows[6][1])]
    got = passage_dedup.without_repeated_passages(make(rows), span=span).collect()
    assert Counter(map(tuple, [r[:4] for r in got])) == Counter(plain_passages(rows, span))
    assert all(r["n_deleted"] == sum(d["end"] - d["start"] for d in r["deleted"]) for r in got)


def test_passage_inside_longer_lines(make, vocabulary):
    rng = random.Random(8)
    passage, own = prose(rng, vocabulary, 60), [prose(rng, vocabulary, 30) for _ in range(4)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]} {passage} {own[3]}")]
    got = dict(r[:2] for r in passage_dedup.without_repeated_passages(make(rows)).collect())
    assert got == {1: rows[0][1], 2: f"{own[2]} {own[3]}"}
    assert passage_dedup.without_repeated_passages(make([])).count() == 0


# --- N-gram Jaccard join -------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_near(rows):
    sets = [shingles(t) for _, t in rows]
    order = [(d is not None, d or 0) for d, _ in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links[j] if k not in reach]
            reach |= set(todo)
        same = [j for j in range(len(rows)) if j == i or sets[i] and sets[j] == sets[i]]
        first = lambda ks: rows[min(ks, key=lambda k: order[k])][0]
        out.append((doc, first(reach), first(same), len(same), len(links[i])))
    return out


@pytest.mark.parametrize("block", [near_join.BLOCK, 3])
def test_near_classes(make, vocabulary, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK", block)
    rng = random.Random(9)
    rows = corpus(vocabulary, 9, 30)
    base = prose(rng, vocabulary, 150).split()
    for i in range(25):  # a group of near copies, some just below the threshold
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    got = near_join.near_classes(make(rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_near(rows))
    left = near_join.one_of_each(make(rows)).select("doc_id").collect()
    ids = [d for d, _ in rows]
    expected = {d for d, c, *_ in plain_near(rows) if d == c}
    assert {r[0] for r in left} - {ids[0], ids[3]} == expected - {ids[0], ids[3]}


def test_near_join_of_nothing(make):
    assert near_join.near_classes(make([])).count() == 0
    assert [tuple(r) for r in near_join.near_classes(make([(1, None)])).collect()] == [(1, 1, 1, 1, 0)]


def test_pruning_keeps_what_may_reach_the_threshold():
    need = near_join.required_matches(0.8, 1e-6, 96)
    assert need[8] <= 2 and 55 < need[96] < 77
    assert (np.diff(need) >= 0).all()
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 32, (20, 96), dtype=np.uint32)
    right = left.copy()
    right[10:] = rng.integers(0, 1 << 32, (10, 96), dtype=np.uint32)
    i, j = near_join.survivors(left, right, need)
    assert list(zip(i, j)) == [(k, k) for k in range(10)]


def test_exact_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (5, 30, 31, 1, 50)]
    plain = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_join.shared_counts(sets, None)
    assert (np.triu(got, 1) == np.triu(plain, 1)).all()
    assert (near_join.shared_counts(sets[:2], sets[2:]) == np.array(plain)[:2, 2:]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = dict(tuple(r) for r in near_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
