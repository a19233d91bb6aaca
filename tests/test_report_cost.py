"""Reports at size: what rendering moves, and that quick tests of lines tell what the fields tell."""

from __future__ import annotations

import datetime
import gzip
import re

from pyspark.sql import functions as F

from reportlake import catalog
from reportlake.operators.extract import production_long, production_typed, production_wide
from reportlake.plans.grammar import GRAMMARS, default_plan
from reportlake.sources.rendered import render_reports


def _tables(spark, folder):
    day = datetime.date
    rows = {
        "region": ([(0, "ASIA")], "r_regionkey bigint, r_name string"),
        "nation": ([(0, "INDIA", 0)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "supplier": ([(1, "Supplier#1", 0)], "s_suppkey bigint, s_name string, s_nationkey bigint"),
        "part": ([(5, "red rod", "Brand#12"), (6, "old bolt", "Brand#12")], "p_partkey bigint, p_name string, p_brand string"),
        "lineitem": (
            [(1, 5, 1.5, day(2001, 1, 3)), (1, 5, 1.75, day(2001, 1, 9)), (1, 6, 2.75, day(2001, 1, 9)), (1, 6, 4.0, day(2002, 12, 1)), (1, 6, None, None)],
            "l_suppkey bigint, l_partkey bigint, l_quantity double, l_shipdate date",
        ),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_rendering_moves_lines_once(spark, tmp_path):
    _tables(spark, tmp_path)
    docs = render_reports(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    (doc,) = docs.collect()
    lines = [" ".join(line.split()) for line in doc["value"].splitlines()]
    # quantities are cut to whole ones by part and month; a year without a date has no line
    assert "2001 5" + " 0" * 11 + " 5" in lines and "2002" + " 0" * 11 + " 4 4" in lines
    assert [line for line in lines if "#" in line and line[0] == "0"] == ["0000005 red rod #5", "0000006 old bolt #6"]
    assert lines[-2] == "Totals 5" + " 0" * 10 + " 4 9"


def test_rendering_moves_no_lists_when_nothing_is_broadcast(spark, tmp_path):
    _tables(spark, tmp_path)
    wanted = sorted(render_reports(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = render_reports(spark, str(tmp_path))
        plan = docs._jdf.queryExecution().executedPlan().toString()
        # lineitem goes to its parts and to its suppliers; its lists and sums are never moved
        assert plan.count("Exchange hashpartitioning(l_partkey") == 1
        assert plan.count("Exchange hashpartitioning(l_suppkey") == 1
        assert sorted(docs.collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_a_list_are_marked_once(spark):
    lines = [
        "0000005       red rod #5", "1234567890", "12345678901", "12345678901 x", "x", "é" * 10 + " y", "é" * 11 + " y", " " * 8, " " * 8 + "x",
        " " * 9 + "x", " " * 9, " " * 7, "   Edit   Wells", " " * 12 + "Edit", "Edits a", "Editor", "Edi t", "\tx", "a b c",
    ]
    grammar, line = GRAMMARS["Permit_Well"], F.col("l")
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select("l", grammar.matches(line).alias("m"), grammar.parse(line).alias("p"))
    for row in rows.collect():
        text = row["l"]
        body = text.lstrip(" ")
        indent, word = len(text) - len(body), text.split(" ")[0]
        bare = indent == 8 and not body
        assert row["m"] == (not body.startswith("Edit") and (indent == 0 and 1 <= len(word) <= 10 or bare or indent > 8)), text
        assert row["p"]["Permit"] == (word if indent == 0 else None), text
        name = (None if bare else body) if indent else (text[len(word):].lstrip(" ") if text != word else None)
        assert row["p"]["Well"] == name, text
    assert all(GRAMMARS[n].quick for n in ("Permit_Well", "Buyer_Lease_Type_Active")) and not default_plan().detail.grammar.quick


def test_page_breaks_do_not_change_rows(spark):
    head = ["X County; Y Quad; Z Field Pool", "Buyer:  B  Lease#: 1  Production  Type  Oil  Production Unit", "Wells In Unit", "Permit #      Well Name"]
    wells = [f"{i:07d}   well {i}" for i in range(4)]
    year = "  {} " + " ".join(["  1"] * 13)
    table = ["  Year   Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Totals", *[year.format(y) for y in range(2000, 2004)]]
    plain = [*head, *wells, "   Edit   Wells", *table, "end"]
    broken = [*head, *wells[:2], "footer", "\f" + wells[2], wells[3], *plain[8:-3], "footer", "\f" + plain[-3], *plain[-2:]]
    docs = spark.createDataFrame([("a", "\n".join(plain)), ("b", "\n".join(broken))], "doc_id string, value string")
    rows = {}
    for row in production_wide(docs, position=True).orderBy("line_no").collect():
        rows.setdefault(row["doc_id"], []).append((row["Year"], row["Permit"].replace("\f", ""), row["Well"], row["Totals"]))
    wanted = ("; ".join(f"{i:07d}" for i in range(4)), "; ".join(f"well {i}" for i in range(4)), "1")
    assert rows == {k: [(str(y), *wanted) for y in range(2000, 2004)] for k in "ab"}


def test_columns_that_are_not_read_are_not_worked_out(spark):
    docs = spark.createDataFrame([("a", "x\ny")], "doc_id string, value string")
    rows = production_long(docs)
    lists = [r" [^\n]*+", r"(?dm)^[^ \n]*+ *+"]
    # the texts of a list are joined where its columns are read, and only there
    whole, part = (
        rows.select(*names)._jdf.queryExecution().optimizedPlan().toString() for names in (["permit", "well"], ["county", "volume"])
    )
    assert all(text in whole and text not in part for text in lists)


def test_compiled_code_is_short_enough_for_the_jvm(spark):
    docs = spark.createDataFrame([("a", "x\ny")], "doc_id string, value string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    for rows in (production_wide(docs), production_typed(docs), production_long(docs)):
        code = rows._jdf.queryExecution().explainString(mode)
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        # methods of more bytes are never compiled
        assert sizes and max(sizes) < 8000


def test_texts_of_a_list_are_those_of_its_lines(spark):
    lines = [
        "0000005       red rod #5", "1234567890", "x", "é" * 10 + " y", " " * 8, " " * 9 + "x", " " * 9, "a b c", "a ", "a\r b", "a b  c d",
        "\ta\f  b\x0bc", " " * 10 + "x  y ", "None", "$1 \\1",
    ]
    grammar = GRAMMARS["Permit_Well"]
    docs = spark.createDataFrame([(lines,), (lines[::-1],), ([lines[4]],), ([lines[1]],), ([],)], "ls array<string>")

    def each(name):
        return F.array_join(F.transform("ls", lambda line: F.coalesce(grammar.parse_entry(line)[name], F.lit("None"))), "; ")

    values = {n: each(n) for n in ("Permit", "Well")}
    rows = docs.select(
        *[v.alias(f"each_{n}") for n, v in values.items()],
        *[grammar.joined(F.col("ls"), n, "; ", "None").alias(f"all_{n}") for n in values],
    )
    for row in rows.collect():
        assert row["all_Permit"] == row["each_Permit"] and row["all_Well"] == row["each_Well"]


def test_cut_steps_are_worked_out_once(spark):
    """Written out step by step, the type of a buyer's line held the steps before it some hundred times."""
    lines = spark.createDataFrame([("x",)], "l string")
    for name in ("County_Quad_Pool", "Buyer_Lease_Type_Active"):
        parsed = lines.select(GRAMMARS[name].parse(F.col("l")).alias("p"))
        plan = parsed._jdf.queryExecution().analyzed().toString()
        assert plan.count("substr") < 40, name


def test_cut_fields_of_awkward_lines(spark):
    def after(text, label):
        return text.partition(label)[2]

    buyers = [
        "Buyer:  Ann, Buyer's  Lease#:  7 Lease#: 8 Production  Type  Gas  Production Unit",
        "  Buyer: Ä€\U0001f600,  Lease#: Production  Type   OilProduction  Unit Type x",
        "Buyer: Lease#: 1Production Type ",
        "Buyer: a Buyer: b Lease#: Production x Production Type Oil Production Type Gas",
    ]
    for line, row in zip(buyers, spark.createDataFrame([(b,) for b in buyers], "l string").coalesce(1).select(GRAMMARS["Buyer_Lease_Type_Active"].parse(F.col("l")).alias("p")).collect()):
        body = line.lstrip(" ")[len("Buyer: "):]
        named, rest = body.partition("Lease#: ")[0], after(body, "Lease#: ")
        at = re.search("Production +Type ", rest)
        kind = rest[at.start() + len("Production"):].lstrip(" ")[len("Type "):].lstrip(" ")
        word, unit = kind.split(" ")[0], re.search("Production +Unit", kind)
        word = word[: unit.start()] if unit else word
        buyer = re.sub(",$", "", re.sub("Buyer's$", "", named.strip(" ")).strip(" "))
        assert tuple(row["p"]) == (buyer, rest[: at.start()].strip(" "), word), line
    places = [
        "A County; B Quad; C Field Pool",
        " é County;  County; Quad; x Quad;  Field  Field   Pool Field Pool",
        "County; Quad;  Field Pool",
    ]
    for line, row in zip(places, spark.createDataFrame([(p,) for p in places], "l string").coalesce(1).select(GRAMMARS["County_Quad_Pool"].parse(F.col("l")).alias("p")).collect()):
        rest = after(line, "County; ")
        pool = after(rest, "Quad; ")
        pool = pool[: re.search(" Field +Pool", pool).start()]
        assert tuple(row["p"]) == tuple(t.strip(" ") for t in (line.partition("County; ")[0], rest.partition("Quad; ")[0], pool)), line


def test_the_ordered_report_is_kept_compressed(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    day = datetime.date
    lines = [(1, 5 + i % 2, 1.0 + i, day(1995 + i % 7, 1 + i % 12, 1)) for i in range(84)]
    lines = spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double, l_shipdate date")
    lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalog, "shared_folder", lambda spark: str(tmp_path / "kept"))
    rows = sorted(map(tuple, catalog.QUERIES["report_ordered"](spark, str(tmp_path)).collect()))
    assert rows == [(i, "112", year) for i, year in enumerate([*map(str, range(1995, 2002)), "Totals"], 1)]
    parts = list((tmp_path / "kept" / "report.csv").glob("part-*"))
    plain = [gzip.decompress(p.read_bytes()) for p in parts]
    assert b"".join(plain).count(b"red rod #5; old bolt #6") == 8
    assert sum(p.stat().st_size for p in parts) < sum(map(len, plain)) / 2
