from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from random_reports import report
from reportlake.functions import pages, text
from reportlake.operators import landing, worklist
from reportlake.operators.lines import explode_lines, split_undecodable
from reportlake.operators.numbering import enumerated, numbered, running_total


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_lines_equal_plain_reading(spark):
    rng = random.Random(3)
    texts = {i: report(rng) for i in range(300)}
    texts[900], texts[901], texts[902] = "", "\f", "\f\n\fa\nb\nc\r\r\n\r\nd\n"
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, value string")
    got = {}
    for r in explode_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.line, r.line_next, r.is_current, r.page_no))
    for key, body in texts.items():
        kept = [(n, raw.strip("\r\n")) for n, raw in enumerate(body.split("\n"), 1)]
        kept = [(n, x) for n, x in kept if x]
        expected, page, opening = [], 0, True
        for i, (n, x) in enumerate(kept):
            page += x.startswith("\f")
            ahead = kept[i + 1][1] if i + 1 < len(kept) else None
            current = ahead is not None and not ahead.startswith("\f")
            opening = opening and x.startswith("\f")
            if current and opening:
                current = False
            expected.append((n, x, ahead, current, page))
        assert sorted(got.get(key, [])) == expected, body


def test_undecodable_lines_end_the_document(spark):
    raw = [(1, b"a\nb\n"), (2, b"a\nb\xff\nc"), (3, b"\xff")]
    docs = spark.createDataFrame(raw, "doc_id int, value binary")
    good, cut = split_undecodable(docs)
    assert values(good, "doc_id", "value") == [(1, "a\nb\n"), (2, "a"), (3, "")]
    assert values(cut, "doc_id", "line_no") == [(2, 2), (3, 1)]


def test_numbering_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(("hot" if i % 3 else f"k{i % 50}"), i * 1000, rng.randint(0, 5)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p long, v long")
    out = running_total(df, ["k"], "p", F.col("v"), "total").collect()
    sums, expected = {}, {}
    for k, p, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        expected[(k, p)] = sums[k]
    assert {(r.k, r.p): r.total for r in out} == expected
    assert [r.n for r in numbered(df.where("k = 'hot'"), ["k"], "p", "n").orderBy("p").collect()] == list(range(1, 2001))


def test_enumerated_strings(spark):
    names = sorted({f"n{random.Random(i).randint(0, 10**6)}é" for i in range(2000)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(x,) for x in reversed(names)], "option string").repartition(5)
    out = enumerated(df, "option").orderBy("n").collect()
    assert [(r.option, r.n) for r in out] == [(x, i) for i, x in enumerate(names, 1)]


def test_file_names_in_list_order(spark):
    rng = random.Random(9)
    options = [rng.choice(["a", "a/b", "a?b", "x.y", "é ü", "c", "q_(2)"]) for _ in range(400)]
    taken = {"a.xls", "a_(1).xls", "a_(3).xls", "a_b_(2).xls", "c_(1).xls", "x.y_(0).xls", "x.y_(07).xls", "other.xls"}
    requests = spark.createDataFrame([(i, o, ".xls") for i, o in enumerate(options, 1)], "n int, option string, ext string")
    existing = spark.createDataFrame([(x,) for x in taken], "file_name string")
    got = {r.n: r.file_name for r in worklist.plan_file_names(requests, existing).collect()}
    used, expected = set(taken), {}
    for i, option in enumerate(options, 1):
        base = re.sub(rf"[^\s\w{text._KEPT}]+", "_", option)
        name, m = base + ".xls", 1
        while name in used:
            name = f"{base}_({m}).xls"
            m += 1
        used.add(name)
        expected[i] = name
    assert got == expected
    assert len(set(got.values())) == len(options)


def test_competing_plain_names_stay_unique(spark):
    options = ["s", "s", "s_(1)", "s", "s_(1)", "s_(1)_(1)"]
    requests = spark.createDataFrame([(i, o, ".x") for i, o in enumerate(options)], "n int, option string, ext string")
    existing = spark.createDataFrame([], "file_name string")
    got = [r.file_name for r in worklist.plan_file_names(requests, existing).orderBy("n").collect()]
    assert got == ["s.x", "s_(2).x", "s_(1).x", "s_(3).x", "s_(1)_(2).x", "s_(1)_(1).x"]


def test_resume_and_remaining(spark):
    listed = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "n int, option string")
    assert values(worklist.resume_from(listed, "a"), "n") == [(2,), (3,), (4,)]
    assert values(worklist.resume_from(listed, "b"), "n") == [(1,), (2,), (3,), (4,)]
    assert values(worklist.resume_from(listed, "zz"), "n") == []
    assert values(worklist.resume_from(listed, ""), "n") == [(1,), (2,), (3,), (4,)]
    files = spark.createDataFrame([("b.xls",), ("c.d.xls",), (".a",)], "file_name string")
    assert values(worklist.remaining(listed, files), "option") == [("a",), ("c",)]
    assert worklist.worklist_size(listed, files).first().asDict() == {"n_listed": 4, "n_remaining": 2}
    label = worklist.with_label(listed.where("n = 1")).first().label
    assert label == "{index:6d}. {option} ".format(index=1, option="b")


def test_fallback(spark):
    requested = spark.createDataFrame([("x",), ("q",)], "option string")
    available = spark.createDataFrame([("w", 2), ("v", 1), ("x", 3)], "listed string, position int")
    out = worklist.with_fallback(requested, available)
    assert values(out, "option", "chosen", "fell_back") == [("q", "v", True), ("x", "x", False)]


def test_attempts(spark):
    log = [
        ("a", 1, "retry"), ("a", 2, "ok"), ("b", 1, "retry"), ("b", 2, "retry"), ("b", 3, "retry"), ("b", 4, "ok"),
        ("c", 1, "not_found"), ("c", 2, "ok"), ("d", 1, "retry"),
    ]
    df = spark.createDataFrame(log, "option string, attempt int, status string")
    out = worklist.attempt_rollup(df)
    assert values(out, "option", "outcome", "n_attempts") == [
        ("a", "ok", 2), ("b", "failed", 3), ("c", "not_found", 1), ("d", "pending", 1),
    ]


def test_landing_limits(spark):
    rows = [("t/a.xls", 20, 1), ("t/b.xls", 21, 1), ("t/c.part", 99, 9), ("t/d.xls", 10, 9), ("t/e.xls", 11, 9)]
    df = spark.createDataFrame(rows, "path string, length long, at int").withColumn(
        "modificationTime", F.timestamp_seconds("at")
    )
    out = landing.landing_state(df, F.timestamp_seconds(F.lit(5)))
    assert values(out, "path", "state") == [
        ("t/a.xls", "discard"), ("t/b.xls", "stale"), ("t/c.part", "partial"), ("t/d.xls", "not_ready"), ("t/e.xls", "ready"),
    ]
    assert [r.moved_as for r in out.where("state = 'stale'").collect()] == ["_b.xls"]
    assert landing.newest_file(df.withColumn("k", F.lit(1)), ["k"]).first().path == "t/e.xls"
    assert landing.new_files(df, df.where("at = 1")).count() == 3


def test_text_functions(spark):
    url = "http://data.example.org/list/well.aspx?KEY=&N="
    df = spark.createDataFrame([(url, "d/x.tar.gz", "a/b:c*é (1)'[]")], "u string, p string, o string")
    r = df.select(
        text.dataset_folder(F.col("u"), cut_at=".aspx").alias("cut"),
        text.dataset_folder(F.col("u"), "--permit").alias("whole"),
        text.option_url(url, F.lit("77")).alias("option_url"),
        text.base_name(F.col("p")).alias("base"),
        text.stem(F.col("p")).alias("stem"),
        text.extension(F.col("p")).alias("ext"),
        text.stem(F.lit(".hidden")).alias("hidden"),
        text.safe_file_name(F.col("o")).alias("safe"),
        text.hash_cleanup(F.lit("9523.#6")).alias("mixed"),
        text.hash_cleanup(F.lit("###")).alias("pure"),
        text.has_null([F.col("u"), F.lit(None)]).alias("bad"),
        text.null_to_text(F.lit(None).cast("string")).alias("none"),
        text.fill_placeholders(F.lit("&<prog>.log"), {"prog": F.lit("x")}).alias("filled"),
    ).first()
    assert r.asDict() == {
        "cut": "data.example.org-list-well", "whole": "data.example.org-list-well.aspx?KEY=&N=--permit",
        "option_url": url + "77", "base": "x.tar.gz", "stem": "x.tar", "ext": ".gz", "hidden": ".hidden",
        "safe": "a_b_c_é (1)'_", "mixed": "9523.6", "pure": "###", "bad": True, "none": "None", "filled": "&x.log",
    }


def test_page_functions(spark):
    html = """<html><title>XYZ Records</title><!-- <select><option value="no"> --><form>
    <select id=s><option value="b &amp; c">B</option><OPTION selected value=a>A</option>
    <option value='a'></option><optgroup><option value="hidden"></option></optgroup></select>
    <table><tr><th>Well Name</th><th>x</th></tr><tr><td><b>Well Name</b></td></tr></table>
    <table><tr><th> Pool Name</th><tr><th><i>Pool</i> Name</table></form></html>"""
    df = spark.createDataFrame([(html, "http://x/?API=5")], "h string, u string")
    h = F.col("h")
    r = df.select(
        pages.option_values(h).alias("options"),
        pages.is_page(h, F.col("u"), "XYZ", F.lit("5")).alias("page"),
        pages.has_no_wells(h).alias("no_wells"),
        pages.has_data_table(h).alias("data"),
        pages.has_no_records(h).alias("no_records"),
        pages.has_no_records(F.lit("<tr><td>There are no production records for this well.</td>")).alias("none"),
    ).first()
    assert r.options == ["b & c", "", "a"]
    odd = """<a title="x>y" href="/z"><a title="see href=bad" href="/ok"><A HREF=/p?a&amp;b><a name='n'><a href='one' href='two'>
    <abbr href="no"><a data-href="no" href = "&#233;&#x1F600;&lt;&unknown;&amp;lt;&#0;&apos;">"""
    values = spark.range(1).select(pages.attribute_values(F.lit(odd), "a", "href").alias("v")).first().v
    assert values == ["/z", "/ok", "/p?a&b", "one", "é\U0001F600<&unknown;&lt;\uFFFD'"]
    assert (r.page, r.no_wells, r.data, r.no_records, r.none) == (True, True, True, False, True)


def test_pages_are_read_as_a_parser_reads_them(spark):
    """Comments, scripts, values and open ends hide what looks like a tag."""
    from reportlake.functions import pages

    def one(make, html):
        return spark.createDataFrame([(html,)], "h string").select(make(F.col("h")).alias("x")).first().x

    links = lambda h: one(lambda c: pages.attribute_values(c, "a", "href"), h)
    assert links("<!-- <a href='/c'> --><script>var s='<a href=\"/s\">';</script><a href=/ok>") == ["/ok"]
    assert links("<style><a href=1></style><A HREF='2' href=3><a title='<a href=4>' href=a>b><abbr href=5><a/href=6>") == ["2", "a", "6"]
    assert links("<textarea><a href=1></textarea ><a href=2 <a href=3><a x='1>2' href = \"&lt;&#62;\">") == ["2", "<>"]
    assert links("<!--><a href=1>--><!---><a href=2><!-- x --!><a href=3><!x <a href=4><?y ?><a href=5></a href=6><a href='7") == ["1", "2", "3", "5"]
    assert links("1 < 2 <a> <a href> <a href=''> <scripts><a href=x></scripts><script>never <a href=y>") == ["", "", "x"]
    options = lambda h: one(pages.option_values, h)
    assert options("<script>var s='<select><option value=\"s\">'</script><select><option value=2><optgroup><option value=3></optgroup>") == ["2"]
    title = lambda h: one(pages.title, h)
    assert title("<!--<title>no</title>--><script>'<title>no</title>'</script><title>yes\n a &amp; b <i> &lt;\t</title><title>x</title>") == "yes a & b <i> <"
    assert title("no title") == "" and title("<title/>x<b></title>") == "x<b>" and title("<titles>x</titles>") == ""
    state = lambda h: one(lambda c: pages.page_state(c, by_well=True), h)
    assert state("<form><!--<table><tr><th>Well Name--><table><tr><th>Pool Name</th></tr></table></form>") == "data"
    assert state("<form><table><tr><th a='>'>Well&#32;Name</th></tr></table></form>") == "no_data"
    long = "<a href=1>" + "<a " * 100_000 + "<!--" * 50_000
    assert links(long) == ["1"] and len(links("<a href='x>'>" * 50_000)) == 50_000
