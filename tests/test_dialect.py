from __future__ import annotations

import random
import re

import pytest
from plain_reader import read_line
from pyspark.sql import functions as F
from random_reports import buyer, listed, place

from reportlake.plans.dialect import compile_pattern
from reportlake.plans.grammar import GRAMMARS, Grammar, default_plan, expand_header, settings_from_config

# Patterns and lines where the two dialects, or null and empty groups, could differ.
CASES = [
    (r"(?P<a>x)?(?P<b>y*)", ["", "x", "y", "xyy", "z"]),
    (r"(?:(?P<sign>[+-])|(?P<coin>[$€]) ?)?(?P<number>\d+)(?P<unit>k)?", ["-7", "$ 12k", "€3", "5", "+k", "$  4", ""]),
    (r"(?P<a>\d{,2})-(?P<b>\w+)", ["-a", "1-é_", "12-x y", "123-x", "٣-x"]),
    (r"(?P<a>[[\]&&a]+)(?P<b>{x}|)", ["[]&a{x}", "a", "&&"]),
    (r"(?P<a>a+?)(?P<b>a|b)(?P=a)", ["aba", "aaa", "abab", "ab"]),
    (r"(x|(?P<a>y))+(?P<b>.*)$", ["xyz", "yxz", "xx", "y"]),
    (r"(?P<a>.+)(?P<b>\s)(?P<c>\S*)", ["a\u0085b", "a b", "a b", "ab"]),
    (r"(?i)(?P<a>AB)(?!c)(?P<b>.)?", ["abd", "ABc", "ab"]),
    (r"(?i)(?P<a>É+)(?P<b>s)?", ["é", "ÉéS", "e"]),
    (r"(?P<a>x\b)(?P<b>\B-)?(?P<c>.*)", ["xé", "x é", "x", "x-", "x_", "x--"]),
    (r"(?P<a>[\b]?)(?P<b>.*)", ["\x08a", "a"]),
    (r"(?P<with_underscore>\w)(?P<n>(?P<inner>z)|q)?", ["az", "aq", "a", "b_"]),
]


@pytest.mark.parametrize("pattern, lines", CASES)
def test_groups_equal_python(spark, pattern, lines):
    grammar = Grammar("g", pattern)
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    line = F.col("l")
    out = df.select(
        "l",
        grammar.matches(line).alias("matches"),
        grammar.all_present(line).alias("present"),
        *[F.when(grammar.matches(line), c).alias(n) for n, c in grammar.values(grammar.parse(line)).items()],
    ).collect()
    for r in out:
        found = re.match(pattern, r.l)
        assert r.matches == (found is not None), (pattern, r.l)
        groups = found.groupdict() if found else dict.fromkeys(grammar.fields)
        assert {n: r[n] for n in grammar.fields} == groups, (pattern, r.l)
        assert r.present == bool(found and None not in groups.values()), (pattern, r.l)


FIELDS = {
    "Moss County; LOW Quad; Sand Field Pool": ("County_Quad_Pool", {"County": "Moss", "Quad": "LOW", "Pool": "Sand"}),
    " County;   Quad;  Field  Pool": ("County_Quad_Pool", {"County": "", "Quad": "", "Pool": ""}),
    " A County; County; B Quad; C Field  Pool more": ("County_Quad_Pool", {"County": "A", "Quad": "County; B", "Pool": "C"}),
    "Buyer:  Tin & Zinc   Lease#: 31  Production  Type  Oil": ("Buyer_Lease_Type_Active", {"Buyer": "Tin & Zinc", "Lease": "31", "Type": "Oil"}),
    " Buyer: One, Two, Buyer's Lease#: Production Type GasProduction Unit": ("Buyer_Lease_Type_Active", {"Buyer": "One, Two", "Lease": "", "Type": "Gas"}),
    "Buyer: X Lease#: 7 Production Type Production Unit": ("Buyer_Lease_Type_Active", {"Buyer": "X", "Lease": "7", "Type": ""}),
    "K12   Stone Bank ": ("Permit_Well", {"Permit": "K12", "Well": "Stone Bank "}),
    "K12 ": ("Permit_Well", {"Permit": "K12", "Well": ""}),
    "K12": ("Permit_Well", {"Permit": "K12", "Well": None}),
    "         Stone Bank": ("Permit_Well", {"Permit": None, "Well": "Stone Bank"}),
    "        ": ("Permit_Well", {"Permit": None, "Well": None}),
    "         ": ("Permit_Well", {"Permit": None, "Well": ""}),
    "  Permit  #  Well Names": ("Permit_Well_header", {}),
    " Edit  Wells": ("Permit_Well_end", {}),
    " Year " + " ".join("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Totals".split()): ("Product_by_month_header", {}),
}
OTHER = ["", " ", "A County;B Quad; C Field Pool", "A County; B Quad; Field Pool", "Buyer: A Lease#: 1 Production Type",
         "Permit Name", "12345678901 x", "        x", "   x", "Edit", "Year Jan"]


def test_default_grammars(spark):
    """Every sample line is read as described; plain and distributed reading agree on all."""
    rng = random.Random(3)
    made = [f(rng) for f in (place, buyer, listed) for _ in range(150)]
    lines = [*FIELDS, *OTHER, *made, *[x[: len(x) // 2] for x in made]]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(lines)], "l string")
    for grammar in GRAMMARS.values():
        if grammar.wide:
            continue
        line = F.col("l")
        values = grammar.values(grammar.parse(line))
        out = df.select("l", grammar.matches(line).alias("m"), grammar.all_present(line).alias("p"), *[c.alias(n) for n, c in values.items()])
        for r in out.collect():
            plain = read_line(grammar.name, r.l)
            assert r.m == (plain is not None), (grammar.name, r.l)
            assert r.p == (plain is not None and None not in plain.values()), (grammar.name, r.l)
            if plain is not None:
                assert {n: r[n] for n in grammar.fields} == plain, (grammar.name, r.l)
            kind, fields = FIELDS.get(r.l, (None, {}))
            if kind == grammar.name and fields:
                assert plain == fields, r.l
            if kind == grammar.name:
                assert r.m, r.l


def test_optional_groups_are_known():
    assert not compile_pattern(r"(?P<a>x)(y|z)").optional
    assert set(compile_pattern(r"(?:(?P<a>x)|y)(?P<b>z)").optional) == {"a"}
    assert set(compile_pattern(r"(?P<a>x){,3}(?P<b>z)+").optional) == {"a"}
    with pytest.raises(ValueError):
        compile_pattern("(a")


def test_settings():
    settings = settings_from_config(
        {
            "tasks_list": "County_Quad_Pool, Mine, Product_by_month",
            "tasks_branch_from_to_list": "Product_by_month, Product_by_month",
            "re_mine": r"(?P<Field>\w+)",
            "header_list": "Field,<Product_by_month>,<File>",
            "b_search_in_subdirs": "False",
            "path": "in/*.txt",
        }
    )
    plan = settings.plan
    assert [s.name for s in plan.stages] == ["County_Quad_Pool", "Mine", "Product_by_month"]
    assert plan.columns[0] == "Field" and plan.columns[-1] == "File" and plan.sticky == 2
    assert settings.options == {"b_search_in_subdirs": False, "path": "in/*.txt"}
    with pytest.raises(ValueError, match="Unknown"):
        settings_from_config({"tasks_list": "Unknown"})
    with pytest.raises(ValueError):
        expand_header(["<Nothing>"], GRAMMARS)


def test_default_columns():
    assert ",".join(default_plan().columns) == (
        "Buyer,Pool,Permit,Well,Quad,County,Type,Lease,Year,Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec,Totals,File"
    )
