"""Lines against many grammars at once.

``classify`` tries every grammar on every line. Here one automaton over the fixed words of all grammars passes
over a line and names the few grammars whose words all occur in it; only these are tried. The grammars travel as
one constant, and a line meets its own by number, so the plan is the same for ten grammars and ten thousand.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.operators.staging import stage
from reportlake.plans.dialect import fixed_words
from reportlake.plans.grammar import Grammar

_TABLE = "array<struct<name:string,java:string,fields:array<string>,places:array<int>,present:array<string>>>"


def worth_trying(line: Column, grammars: list[Grammar]) -> Column:
    """Numbers of the grammars all of whose fixed words occur in a line; null for a null line.

    A grammar without fixed words is always among them.
    """
    needed = [sorted({*fixed_words(g.pattern), *g.needs}, key=lambda w: (-len(w), w)) for g in grammars]
    always = [i for i, words in enumerate(needed) if not words]
    if len(always) == len(grammars):
        return F.when(line.isNotNull(), F.lit(always).cast("array<int>"))
    number = {w: i for i, w in enumerate(sorted({w for words in needed for w in words}))}
    # a grammar is looked up by its longest word, then asked for the others
    by_word: dict[int, list[tuple[int, frozenset[int]]]] = {}
    for i, words in enumerate(needed):
        if words:
            by_word.setdefault(number[words[0]], []).append((i, frozenset(number[w] for w in words[1:])))

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, at in number.items():
            automaton.add_word(word, at)
        automaton.make_automaton()

        def candidates(text):
            if text is None:
                return None
            there = {at for _, at in automaton.iter(text)}
            return sorted([*always, *[i for at in there for i, others in by_word.get(at, ()) if others <= there]])

        for batch in batches:
            yield batch.map(candidates)

    return find(line)


def classify_many(lines: DataFrame, grammars: list[Grammar], line: str = "line", name: str = "grammar", fields: str = "fields") -> DataFrame:
    """``lines`` with ``grammar`` and ``fields``, once for each grammar that matches a line; other lines go.

    ``fields`` maps the named groups to their texts, null for a group that took no part. Grammars are given
    by patterns; the work on a line follows the grammars worth trying, not all of them.
    """
    if any(type(g) is not Grammar for g in grammars):
        raise ValueError("only grammars that are patterns can be looked up by their words")
    rows = [
        {"name": g.name, "java": g.compiled.java, "fields": g.fields, "places": [g.compiled.groups[f] for f in g.fields],
         "present": [g.compiled.optional.get(f) for f in g.fields]}
        for g in grammars
    ]
    text, own = F.col(line), F.col("_own")
    tried = lines.select("*", F.explode(worth_trying(text, grammars)).alias("_at"))
    # lines of one grammar after each other: its pattern is compiled when it changes, not for every line
    tried = tried.sortWithinPartitions("_at")
    table = F.from_json(F.lit(json.dumps(rows)), _TABLE)
    met = stage(tried, _own=F.get(table, F.col("_at"))).where(F.rlike(text, own["java"]))

    def value(_, i: Column) -> Column:
        present = F.get(own["present"], i)
        found = F.call_function("regexp_extract", text, own["java"], F.get(own["places"], i))
        return F.when(present.isNull() | F.rlike(text, present), found)

    return met.select(
        *lines.columns, own["name"].alias(name), F.map_from_arrays(own["fields"], F.transform(own["fields"], value)).alias(fields)
    )
