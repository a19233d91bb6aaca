"""Many grammars at once, against trying each on every line."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from reportlake.operators.classify import classify
from reportlake.operators.many import classify_many, worth_trying
from reportlake.plans.dialect import fixed_words
from reportlake.plans.grammar import CutLine, Grammar


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"abc", ["abc"]),
        (r" *Site: +(?P<Quad>\w+)", ["Site: "]),
        (r"ab?c+d", ["a", "c", "d"]),
        (r"a{2}b{0,3}c{,2}d{1,}e", ["a", "d", "e"]),
        (r"x(ab)+y(cd)?z", ["xab", "y", "z"]),
        (r"x(?:ab)y(?P<n>c|d)e", ["xaby", "e"]),
        (r"a|b", []),
        (r"(?i)abc", []),
        (r"(?i:abc)d", []),
        (r"a(?=b)c(?!d)e(?<=f)g", ["a", "c", "e", "g"]),
        (r"\{a\}\.\d+b[cd]e\\", ["{a}.", "b", "e\\"]),
        (r"(?P<a>q)(?P=a)\1r", ["q", "r"]),
        (r"a++b*?c+?d", ["a", "c", "d"]),
        (r"^a\bb$", ["a", "b"]),
        (r"(a(b|c)*d)e", ["a", "de"]),
        (r"((ab)?c)+d", ["c", "d"]),
        (r"", []),
    ],
)
def test_fixed_words(pattern, words):
    assert fixed_words(pattern) == words


def test_words_are_in_every_match():
    """Random patterns and texts: what Python matches holds all the words."""
    rng = random.Random(7)

    def make(depth):
        pieces = []
        for _ in range(rng.randint(1, 4)):
            piece = rng.choice(["a", "b", "c", r"\.", "[ab]", ".", r"\d"])
            if depth and rng.random() < 0.4:
                piece = rng.choice(["({})", "(?:{})", "({}|{})", "(?={})"]).replace("{}", "%s")
                piece = piece % tuple(make(depth - 1) for _ in range(piece.count("%s")))
            pieces.append(piece + ("" if piece.startswith("(?=") else rng.choice(["", "", "?", "*", "+", "{2}", "{0,2}"])))
        return "".join(pieces)

    matched = 0
    for _ in range(1500):
        pattern = make(2)
        words = fixed_words(pattern)
        for _ in range(15):
            text = "".join(rng.choice("abc.1") for _ in range(rng.randint(0, 9)))
            if re.match(pattern, text):
                matched += bool(words)
                assert all(w in text for w in words), (pattern, text, words)
    assert matched > 500


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Site:", "Well", "12", "x7", "#3", "Año", "", "Well:"]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate([*texts, None, "", "Well" * 20_000])), "n int, line string")


def test_equal_to_each_grammar_on_each_line(spark, lines):
    patterns = [
        r"Site: (?P<name>\w+)", r"(?P<w>Well)? *(?P<n>\d+)", r".*#(?P<n>\d)", r"(?i)site:", r"Well", r"(?P<a>)Año", r"(?:Well|Site: )(?P<r>.*)",
        r"", r"Well: Well (?P<last>\S+)$", r"(Well){3}(?P<more>x)?",
    ]
    grammars = [Grammar(f"g{i}", p) for i, p in enumerate(patterns)]
    want = set()
    for g in grammars:
        found = lines.where(g.matches(F.col("line"))).select("n", *[g.group(F.col("line"), f).alias(f"f_{f}") for f in g.fields])
        want |= {(r["n"], g.name, tuple(sorted((f, r[f"f_{f}"]) for f in g.fields))) for r in found.collect()}
    got = [(r["n"], r["grammar"], tuple(sorted(r["fields"].items()))) for r in classify_many(lines, grammars).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {g for _, g, _ in got} == {g.name for g in grammars}


def test_few_are_tried(spark, lines):
    """Of a thousand grammars a line meets those whose words it holds."""
    grammars = [Grammar(f"g{i}", rf"Site: .*{i}-(?P<x>\d)") for i in range(1000)] + [Grammar("w", r"Well .*#(?P<n>\d)")]
    tried = lines.select("line", F.size(worth_trying(F.col("line"), grammars)).alias("n")).where("line IS NOT NULL").collect()
    assert all(r["n"] == ("Well " in r["line"] and "#" in r["line"]) for r in tried)
    plans = [classify_many(lines, grammars[-k:])._jdf.queryExecution().optimizedPlan().toString() for k in (2, 1000)]
    assert plans[0].count("\n") == plans[1].count("\n") and "from_json" not in plans[1]


def test_odd_tables(spark, lines):
    word = Grammar("w", r"Well(?P<grammar>.*)")
    assert classify_many(lines.limit(0), [word]).count() == 0
    assert classify_many(lines, []).count() == 0
    extra = lines.select("*", F.lit(1).alias("grammar"))
    assert classify_many(extra, [word], name="of").columns == ["n", "line", "grammar", "of", "fields"]
    with pytest.raises(ValueError):
        classify_many(lines, [CutLine("c")])


def test_lines_of_one_grammar_follow_each_other(spark):
    """A pattern that comes with the row is compiled whenever it changes from one row to the next."""
    grammars = [Grammar(str(i), rf"(?P<a>x{i})") for i in range(3)]
    lines = spark.createDataFrame([(f"x{i % 3}",) for i in range(12)], "line string").coalesce(1)
    found = classify_many(lines, grammars)
    assert [r["grammar"] for r in found.collect()] == sorted(str(i % 3) for i in range(12))
