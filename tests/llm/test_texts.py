from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, prose
from pyspark.sql import functions as F

from reportlake.llm import chat, html_text, language_id, pieces, quality, textmap, token_counts

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_the_words():
    texts = ["Ab  c,ab", None, "", "日本 x_y", "ab"]
    raw, ends = textmap.text_bytes(pa.array(texts))
    hashes, bounds = textmap.word_hashes(raw, ends)
    assert np.diff(bounds).tolist() == [3, 0, 0, 3, 1]
    assert hashes[0] == hashes[2] == hashes[6] != hashes[1]
    runs, ends = textmap.joined_hashes(hashes, bounds, 2)
    assert np.diff(ends).tolist() == [2, 0, 0, 2, 1]
    raw, ends = textmap.text_bytes(pa.array(texts).slice(3))
    assert (textmap.word_hashes(raw, ends)[0] == hashes[3:]).all()


# --- Quality -------------------------------------------------------------------


def test_quality_held_out(spark):
    rows = quality.op1_neighbour_voting(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = rows.where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_takes_odd_texts(make, spark):
    docs = make([(i, t) for i, t in enumerate([*ODD, *["plain words here"] * 3, *["*** ### $$$"] * 3])])
    labels = spark.createDataFrame([(9, 1), (10, 1), (12, 0), (12, 0), (13, 0), (11, None), (None, 1), (0, 1)], "doc_id bigint, quality int")
    scores = dict(tuple(r) for r in quality.classify(docs, quality.train(docs, labels)).collect())
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert scores[11] > 0.5 > scores[14] and scores[9] == scores[10]
    unlabelled = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(docs, unlabelled).collect()} == {0.5}
    assert quality.classify(make([]), unlabelled).count() == 0


def test_copies_of_a_labelled_row_are_one(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    docs = [(1, "good words here")] * 5000 + [(1, "another text")] + [(2, "bad !!"), (3, None)]
    seen = []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda terms, marks, *a: seen.append(list(marks)) or plain(terms, marks, *a))
    quality.train(spark.createDataFrame(docs, "doc_id bigint, text string"), labels)
    assert seen == [[0.0, 1.0]]


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(0)
    counts = rng.random((300, quality.TERMS), dtype=np.float32)
    labels = rng.integers(0, 2, 300)
    model = quality.fit(counts, labels)
    mine = quality.Model.score(model, counts[:5])
    for row, got in zip(model.project(counts[:5]), mine):
        cosine = [float(row @ v) for v in model.vectors]
        near = sorted(range(300), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weight = [max(cosine[i], 0) ** quality.SHARPNESS + 1e-9 for i in near]
        assert got == pytest.approx(sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight), abs=1e-3)


# --- Perspectives --------------------------------------------------------------


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob", "<|end|>"), (1, 3, "Ann", None), (1, 300, "Bob", "late"),
        (2, 0, "system", "nobody"), (None, 0, "Ann", "x"), (3, 1, None, "who"), (3, 1, "Cy", "me"), (3, 1, "Cy", "me"),
    ]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS part", "'z' AS speaker")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(frame).collect()}
    assert set(got) == {(1, "Ann", 0), (1, "Ann", 1), (1, "Bob", 0), (1, "Bob", 1), (3, "Cy", 0)}
    ann = got[1, "Ann", 0]
    assert ann["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\nBob: <|end|><|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|end|>", "<|end|>"]
    assert got[3, "Cy", 0]["n_turns"] == 3 and got[3, "Cy", 0]["text"].startswith("<|user|>\nunknown: who")
    assert got[1, "Bob", 1]["text"] == "<|assistant|>\nlate<|end|>\n"
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_no_part_is_longer_than_its_rows(spark):
    rows = [(1, None, "Ann", f"n{i:02}") for i in range(7)] + [(1, 5, "Bob", f"t{i:02}") for i in range(9)] + [(1, 9, "Ann", "last")]
    rows += [(2, None, "Cy", "x")] * 5 + [(3, 4, "Di", "one"), (3, None, "Di", "none")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(frame, part_turns=4).collect()}
    assert max(r["n_turns"] for r in got.values()) == 4 and {k[2] for k in got if k[0] == 2} == {None, 0}
    assert {k[2] for k in got if k[0] == 3} == {None, 1}
    order = sorted({k[2] for k in got if k[0] == 1}, key=lambda p: (p is not None, p or 0))
    assert len(order) == 6
    whole = "".join(got[1, "Ann", p]["text"] for p in order)
    assert re.findall(r"\b(n\d\d|t\d\d|last)<", whole) == [*(f"n{i:02}" for i in range(7)), *(f"t{i:02}" for i in range(9)), "last"]


def test_only_overfull_parts_are_numbered(spark, monkeypatch):
    asked = []
    plain = chat.numbered
    monkeypatch.setattr(chat, "numbered", lambda df, *a: asked.append(df.count()) or plain(df, *a))
    rows = [(1, i, "Ann", "x") for i in range(8)] + [(2, 1, "Bob", "y")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert chat.perspectives(spark.createDataFrame(rows, schema), part_turns=4).count() == 3 and not asked
    same = rows + [(3, 0, "Cy", "again")] * 20_000 + [(3, 9, "Cy", "end")]
    got = chat.perspectives(spark.createDataFrame(same, schema), part_turns=4).where("conv_id = 3").select("part", "n_turns").collect()
    assert asked == [20_000] and len({r["part"] for r in got}) == len(got) == 5_001 and {r["n_turns"] for r in got} == {1, 4}


# --- HTML ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"), sample=60)


def test_blocks():
    texts = lambda h: [b.text for b in html_text.blocks(h)]
    assert texts("<p>a &amp; b&#233;<br>c<p>d  \n e</p>f") == ["a & bé c", "d e", "f"]
    assert texts("<script>if (a<b) '<p>x</p>'</script><style>p{}</style><p title='x>y'>t</p><!-- no <p>n</p> -->") == ["t"]
    assert texts("<b>one <i>two</i></b>three") == ["one twothree"]
    assert texts("1 < 2 <p>x</") == ["1 < 2", "x"] and texts("") == [] and texts("<" * 2000) == ["<" * 2000]
    assert texts("<div>" * 5000 + "deep") == ["deep"] and texts("<!-- open <p>x") == [] and texts("<script>x") == []
    item = html_text.blocks("<nav><ul><li><a href=x>Home</a></ul></nav><article class='post main'><p>t")[1]
    assert item.path == {"<article", ".post", ".main", "<p"}


def test_deep_pages_keep_what_is_around_a_block(page_model):
    deep = "<div>" * 300
    page = f"<article>{deep}<p>one</p><nav><p>menu</p></nav>{'</div>' * 300}<p>two</p></article><p>after</p>"
    got = {b.text: html_text.own_label(b) for b in html_text.blocks(page)}
    assert got == {"one": 1, "menu": 0, "two": 1, "after": 0}
    page = f"<div><article>{'<b>' * 300}x<p>one</p><aside>side</aside></div>two"
    assert [html_text.own_label(b) for b in html_text.blocks(page)] == [1, 1, 0, 0]
    text = "The river rose slowly, and by evening the whole valley had gone quiet under the water."
    page = f"<html><body>{deep}<article>{f'<p>{text}</p>' * 4}</article><footer><p>&copy; 2020 Site</p></footer>{'</div>' * 300}</body></html>"
    assert html_text.main_text(page, page_model).split("\n\n") == [text] * 4
    shut = "<p>x</p></i><a>" * 20_000  # linear: every end tag and block meets all that is open
    assert len(html_text.blocks("<b>" * 20_000 + shut)) == 20_000


def test_long_and_broken_pages_take_linear_time(page_model):
    import time

    begin = time.perf_counter()
    assert [b.text for b in html_text.blocks("<p>a</p>" + "<a " * 100_000)] == ["a", ("<a " * 100_000).strip()]
    assert time.perf_counter() - begin < 2
    text = "The river rose slowly, and by evening the whole valley had gone quiet."
    pages = [f"<nav><p>Home</p></nav><article>{f'<p>{text}</p>' * 4}</article><footer><p>Imprint</p></footer>"] * 30
    pages.append(f"<article>{f'<p>{text}</p>' * 8000}</article>")
    labelled = [(page, [html_text.own_label(b) for b in page]) for page in map(html_text.blocks, pages)]
    begin = time.perf_counter()
    model = html_text.fit(labelled, steps=100)
    assert time.perf_counter() - begin < 60
    assert html_text.main_text(pages[0], model).split("\n\n") == [text] * 4


def test_pages_without_telling_names(page_model):
    """Menu, heading, paragraphs and a foot in bare blocks: the article comes out whole."""
    texts = [
        "The river rose slowly, and by evening the whole valley had gone quiet under the water.",
        "Nobody had expected it so early in the year, for the snow still lay on the hills above the town.",
        "Help came.",
        "On the next morning the first boats went out, and with them the men who knew the old channels best.",
        "It took three weeks until the road to the mill could be used again.",
    ]
    title = "The flood of the year"
    foots = ["&copy; 2020 Valley News", "Copyright Valley News", "Imprint"]
    menus = [["Home", "News", "About us"], ['<a href="/">Home</a>', '<a href="/n">News</a>', '<a href="/c">Contact</a>']]
    for tag in ("div", "p"):
        for foot in foots:
            for menu in menus:
                rows = [*menu, title, *texts, foot]
                flat = "".join(f"<{tag}>{t}</{tag}>" for t in rows)
                nested = "".join(f"<div>{''.join(f'<{tag}>{t}</{tag}>' for t in part)}</div>" for part in (menu, [title, *texts], [foot]))
                for page in (flat, nested):
                    got = html_text.main_text(f"<html><body>{page}</body></html>", page_model).split("\n\n")
                    assert got == [title, *texts], (tag, foot, menu)


def test_self_closed_foreign_elements():
    texts = lambda h: [b.text for b in html_text.blocks(h)]
    assert texts('<p>a<svg class="icon" viewBox="0 0 1 1"/></p><p>b</p>') == ["a", "b"]
    assert texts("<p>a</p><svg/><p>b</p><svg><text>no</text></svg><p>c</p>") == ["a", "b", "c"]
    assert texts("<svg id=a/><text>no</text></svg><p>c</p>") == ["c"] and texts("<script/>no") == []
    assert html_text.blocks("<math/>x")[0].path == frozenset()


def test_viterbi_is_the_best_of_all_paths(page_model):
    rng = random.Random(1)
    names = list(page_model.names)
    for _ in range(30):
        page = [html_text.Block("", rng.sample(names, 3)) for _ in range(rng.randint(1, 8))]
        emit = page_model.scores(page)

        def score(path):
            return page_model.first[path[0]] + sum(emit[i, s] for i, s in enumerate(path)) + sum(page_model.step[a, b] for a, b in zip(path, path[1:]))

        best = max(score([k >> i & 1 for i in range(len(page))]) for k in range(1 << len(page)))
        assert score(page_model.label(page)) == pytest.approx(best)


def test_other_layouts_held_out(spark, page_model):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 40 = 3").collect()]
    made = [x for i, h in enumerate(pages) for x in html_text.other_layouts(h, 100 + i)]
    right = [a == b for page, labels in made for a, b in zip(page_model.label(page), labels)]
    assert len(right) > 500 and np.mean(right) > 0.99


def test_articles_whole(spark, page_model):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.DOTALL)[1]
        plain = " ".join(" ".join(html_text.unescape(re.sub("<[^>]*>", " ", article)).split()).split())
        assert html_text.main_text(r["html"], page_model).split() == plain.split()


def test_extraction_takes_odd_pages(spark, page_model):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p"), (3, "u", "<p")], "page_id int, url string, html string")
    got = [tuple(r) for r in html_text.extract(pages.selectExpr("*", "1 AS text"), page_model).collect()]
    assert sorted(got)[0] == (1, "u", "", 0) and len(got) == 4
    empty = html_text.train(pages.limit(0))
    assert html_text.main_text("<article><p>x</p></article>", empty) == ""


# --- Pieces and tokens ---------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype="<i4").tolist()


def random_texts(vocabulary, seed):
    rng = random.Random(seed)
    texts = [prose(rng, vocabulary, 12) for _ in range(30)] + [t for t in ODD if t]
    return texts + ["a  b", " lead", "tail ", "x\n\n y \n", "▁a b", "ß▁", "𝕏\x00\x7f", "tab\there", "The  quick\nbrown"]


def test_pieces_round_trip(model, vocabulary):
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in random_texts(vocabulary, 1):
        back = decoder.decode(np.array(ids_of(encoder, text), dtype=np.int64)).decode()
        assert back == text.replace("▁", " ")  # the mark itself is read as a space, as the format has it


def test_pieces_equal_a_plain_search(model, vocabulary):
    encoder = pieces.Encoder(model)
    usable = {p: i for i, (p, ok) in enumerate(zip(model.pieces, model.usable)) if ok}
    longest = max(map(len, usable))
    for text in [t[:60] for t in random_texts(vocabulary, 2)]:
        s = "▁" + text.replace(" ", "▁")
        best = [0.0] + [None] * len(s)
        for end in range(1, len(s) + 1):
            options = [best[a] + model.scores[usable[s[a:end]]] for a in range(max(0, end - longest), end) if s[a:end] in usable]
            if s[end - 1] not in usable:
                options.append(best[end - 1] + encoder.unknown_score)
            best[end] = max(options)
        worst = {b: encoder.unknown_score for b in model.byte_ids}
        ids = ids_of(encoder, text)
        bytes_ = sum(len(c.encode()) - 1 for c in s if c not in usable)
        assert sum(worst.get(i, model.scores[i]) for i in ids) - bytes_ * encoder.unknown_score == pytest.approx(best[-1])
        assert ids == encoder.best(s)


def test_pieces_equal_the_library(model, vocabulary):
    """The library's own lattice search over the same pieces, read as a unigram model."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    spec = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    encoder = pieces.Encoder(model)
    for text in random_texts(vocabulary, 3)[:30]:
        score = lambda ids: sum(model.scores[i] for i in ids)
        if not any(ord(c) > 255 for c in text):
            assert score(ids_of(encoder, text[:40])) == pytest.approx(score(library.nbest_encode_as_ids(text[:40], 2)[0]))


def test_texts_in_parts(model, vocabulary, monkeypatch):
    """Many texts at once, cut into parts and searched together or one by one, give what each gives alone."""
    encoder = pieces.Encoder(model)
    texts = ["", *random_texts(vocabulary, 7), "é\u0378" * 90, "𝕏 x" * 70, "▁ ▁" * 50, "z" * 300]
    want = [encoder.best("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    for part, few in ((40, 3), (1 << 20, 48), (500, 0)):
        monkeypatch.setattr(pieces, "PART", part)
        monkeypatch.setattr(pieces, "FEW", few)
        ids, ends = encoder.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert encoder.encode_all([])[1].tolist() == [0] and encoder.encode_all(["", ""])[1].tolist() == [0, 0, 0]


def test_encode_and_decode_rows(make, model):
    docs = make([(1, None), (2, ""), (3, "a  b\nc"), (3, "a  b\nc")]).selectExpr("*", "7 AS piece_ids")
    coded = pieces.encode(docs, model)
    assert coded.columns == docs.columns
    back = pieces.decode(coded, model, text_col="again").collect()
    assert sorted((r["doc_id"], r["text"], r["again"], None if r["piece_ids"] is None else len(r["piece_ids"])) for r in back if r["doc_id"] > 1) == [
        (2, "", "", 0), (3, "a  b\nc", "a  b\nc", 5), (3, "a  b\nc", "a  b\nc", 5)
    ]
    assert [r["again"] for r in back if r["doc_id"] == 1] == [None]
    digests = pieces.digests(make([(i, t) for i, t in enumerate(ODD)]), model).collect()
    assert all(r["round_trip"] for r in digests)
    assert pieces.encode(make([]), model).count() == 0


def greedy(word, known):
    """Longest match first, piece by piece."""
    rest, n = "▁" + word, 0
    while rest:
        fits = [k for k in range(1, len(rest) + 1) if rest[:k] in known and rest.startswith("▁", 0) == (n == 0)]
        if not fits:
            return 0
        rest, n = rest[max(fits) :], n + 1
    return n


def test_token_counts(make, vocabulary):
    listed = token_counts.read_vocabulary()
    texts = random_texts(vocabulary, 4) + [None, ""]
    got = token_counts.count_tokens(make(list(enumerate(texts))), listed).collect()
    for r in got:
        each = [greedy(w, set(listed)) for w in (texts[r["doc_id"]] or "")[:4000].split()]
        if len(texts[r["doc_id"]] or "") <= 4000:
            assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(each), sum(each) + each.count(0), each.count(0))


def test_token_automaton_on_small_vocabularies():
    rng = random.Random(6)
    for _ in range(60):
        known = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        known |= {"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(5)}
        machine = token_counts.Automaton(sorted(known))
        for _ in range(40):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, known)


# --- Language ------------------------------------------------------------------


def plain_bits(text, counts, order):
    """Code length by the book: counts is {context: {byte: n}} over all context lengths."""
    total = 0.0
    padded = b" " * order + text
    for i in range(order, len(padded)):
        ruled, p = set(), 1.0
        for length in range(order, -1, -1):
            seen = counts.get(padded[i - length : i])
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in ruled}
            whole = sum(left.values()) + len(left)
            if padded[i] in left:
                p *= left[padded[i]] / whole
                break
            if left:
                p *= len(left) / whole
            ruled |= set(seen)
        else:
            p /= 256 - len(ruled)
        total -= np.log2(p)
    return total


def test_code_lengths_are_exact():
    rng = random.Random(8)
    order = 2
    sample = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(5)]
    column = lambda texts: language_id._grams(pa.array(texts), order)
    plain = lambda t: re.sub(" +", " ", t).lstrip(" ").encode()
    counts = {}
    for text in sample:
        padded = b" " * order + plain(text)
        for i in range(order, len(padded)):
            for length in range(order + 1):
                seen = counts.setdefault(padded[i - length : i], {})
                seen[padded[i]] = seen.get(padded[i], 0) + 1
    keys, n = np.unique(column(sample)[0], return_counts=True)
    model = language_id.Model(["x"], [keys], [n.astype(float)], order)
    for _ in range(20):
        text = "".join(rng.choice("abcd ") for _ in range(30))
        grams, _ = column([text])
        want = plain_bits(plain(text), counts, order)
        assert model.bits(grams).sum() == pytest.approx(want, rel=1e-4)
        assert language_id._Known(model).bits(grams).sum() == pytest.approx(want, rel=1e-4)


def test_known_grams_with_full_slots(monkeypatch):
    monkeypatch.setattr(language_id, "SLOTS_BITS", 3)
    grams, _ = language_id._grams(pa.array(["the quick brown fox jumps over the lazy dog"]), 4)
    keys, n = np.unique(grams, return_counts=True)
    model = language_id.Model(["x", "y"], [keys, keys[:5]], [n.astype(float), n[:5].astype(float)], 4)
    known = language_id._Known(model)
    for _ in range(3):
        assert np.allclose(known.bits(grams), model.bits(grams))


def test_copies_do_not_fill_the_sample(spark):
    """A language of one text copied 3,000 times is learned, and a copied text counts once."""
    rows = [("ein haus und ein hund im garten", "de")] * 3000 + [(f"the cat number {i} sat on the mat", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language_id.train(docs, sample=50)
    assert model.languages == ["de", "en"]
    one = language_id.train(docs.distinct(), sample=50)
    assert all((a["n"] == b["n"]).all() for x, y in zip(model.levels, one.levels) for a, b in zip(x, y))
    got = language_id.identify(spark.createDataFrame([(1, "ein hund"), (2, "the mat")], "doc_id int, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "de", 2: "en"}


def test_known_grams_stay_few():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 1000, dtype=np.uint64))
    model = language_id.Model(["x"], [keys], [np.ones(len(keys))], 4)
    known = language_id._Known(model)
    for _ in range(20):
        grams = rng.integers(0, 1 << 40, 50_000, dtype=np.uint64)
        assert np.allclose(known.bits(grams)[:100], model.bits(grams[:100]))
    assert len(known.rest) <= 1 << language_id.SLOTS_BITS and known.values.nbytes < 1 << 20


def test_language_held_out(spark):
    rows = language_id.op8_partial_matching(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    rows = rows.where("held_out").collect()
    assert len(rows) > 1000 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_takes_odd_texts(make, spark):
    docs = make([(i, t) for i, t in enumerate([*ODD, "the cat sat on the mat", "le chat est sur la table", "12 34"])])
    train = spark.createDataFrame(
        [("the dog and the cat of the house " * 5, "en"), ("le chien et la maison de la table est " * 5, "fr"), (None, "en"), ("x", None)],
        "text string, lang string",
    )
    model = language_id.train(train)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    unlettered = {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")} | {len(ODD) + 2}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == unlettered
    assert [got[len(ODD) + k]["lang_pred"] for k in (0, 1)] == ["en", "fr"]
    kept = language_id.with_language(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - unlettered
    nothing = language_id.train(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.with_language(docs, nothing).count() == 0
    assert docs.select(language_id.held_out(F.lit(None).cast("bigint"))).first()[0] is False
