"""Monthly reports rendered from the star schema, to exercise the parser at any scale.

One document per supplier and brand, which lists all parts of that brand the
supplier ever shipped.  The text follows the report format line by line; a
document number decides which of the awkward variants it shows.  All of it is
DataFrame work: rows are pre-aggregated to (document, part, year) before
anything is collected, so a list holds a document's calendar years or its
parts, never its base rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions.cells import CELLS, MONTHS

# Document number modulo the first value equal to the second shows the variant.
VARIANTS = {
    "blank_lines": (2, 0),
    "carriage_returns": (3, 1),
    "page_break": (4, 1),
    "junk_line": (5, 2),
    "masked_june": (6, 3),
    "null_permit": (7, 4),
    "no_county": (11, 10),
    "blank_march": (13, 5),
    "mixed_july": (17, 6),
    "lost_buyer": (19, 3),
    "no_table": (23, 7),
}
CELL_WIDTH = 8
BREAK_AFTER = 3
POOL = "Unassigned"
JUNK = "~~ scanned copy ~~"


def _shows(number: Column, variant: str) -> Column:
    modulus, rest = VARIANTS[variant]
    return number % modulus == rest


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lpad(text, F.greatest(F.length(text), F.lit(CELL_WIDTH)), F.lit(" ")))


def _row_text(first: Column, cells: list[Column], number: Column) -> Column:
    out = [F.concat(F.lit("  "), F.rpad(first, F.lit(6), F.lit(" ")))]
    for i, cell in enumerate(cells, 1):
        text = cell.cast("string")
        if i == 3:
            text = F.when(_shows(number, "blank_march"), F.lit("")).otherwise(text)
        if i == 6:
            text = F.when(_shows(number, "masked_june"), F.lit("#####")).otherwise(text)
        if i == 7:
            text = F.when(_shows(number, "mixed_july"), F.concat(F.lit("0#"), text)).otherwise(text)
        out.append(_padded(text))
    return F.concat(*out)


def header_text() -> str:
    return "  Year  " + "".join(" " + name.rjust(CELL_WIDTH) for name in CELLS)


def _optional(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def render_reports(spark: SparkSession, sf_dir: str, by_brand: bool = True) -> DataFrame:
    """``raw_docs(doc_id, value)`` from the tables of one scale directory.

    Without ``by_brand`` a supplier's brands share one document: fewer and longer ones.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part = table("part").select("p_partkey", "p_name", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint").alias("brand"))
    lines = table("lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    month_names = [f"m{i}" for i in range(1, len(MONTHS) + 1)]

    # lineitem gets the names of its parts first and is then moved once, as narrow rows: all that follows is
    # grouped by supplier and more, so it stays there, whether part is small enough to be broadcast or not.
    # Quantities per supplier, part and month give both the table and the list; repeated parts count each.
    cells = lines.select(
        "l_suppkey", "l_partkey", "l_quantity", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    )
    cells = cells.join(part.withColumn("row", F.monotonically_increasing_id()), F.col("l_partkey") == F.col("p_partkey"))
    number = F.col("l_suppkey") * 100 + F.col("brand") if by_brand else F.col("l_suppkey")
    n, key, zero = F.col("number"), F.col("l_partkey").cast("string"), F.lit(0).cast("bigint")
    cells = cells.select("l_suppkey", number.alias("number"), "row", "l_partkey", "p_name", "year", "month", "l_quantity")
    # a number of partitions that Spark does not lessen: parsing a document costs far more than its bytes
    cells = cells.where("l_suppkey IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")
    quantity = F.sum("l_quantity").cast("bigint").alias("q")
    cells = cells.groupBy("l_suppkey", "number", "row", "l_partkey", "p_name", "year", "month").agg(quantity)
    # A row per year with its months, and a row per part: two groupings of the same cells. Months are null in the second.
    by_year = F.struct(F.lit(True).alias("is_year"), "year", F.lit(None).cast("bigint").alias("l_partkey"), F.lit(None).cast("string").alias("p_name"))
    by_part = F.struct(F.lit(False).alias("is_year"), F.lit(None).cast("int").alias("year"), F.col("l_partkey").cast("bigint").alias("l_partkey"), "p_name")
    rows = cells.select("l_suppkey", "number", "month", "q", F.explode(F.array(by_year, by_part)).alias("g")).select(
        "l_suppkey", "number", "month", "q", "g.*"
    )
    rows = rows.groupBy("l_suppkey", "number", "is_year", "year", "l_partkey", "p_name").agg(
        *[
            F.sum(F.when(F.col("is_year"), F.when(F.col("month") == i, F.col("q")).otherwise(zero))).alias(m)
            for i, m in enumerate(month_names, 1)
        ]
    )
    # a line's text is made where it is a row, not inside a document's list
    months = [F.col(m) for m in month_names]
    year_line = _row_text(F.col("year").cast("string"), [*months, sum(months[1:], months[0])], n)
    well_line = F.concat(F.lpad(key, 7, "0"), F.lit("       "), "p_name", F.lit(" #"), key)
    rows = rows.select(
        "l_suppkey", "number", *month_names,
        F.when(F.col("is_year"), F.struct("year", year_line.alias("line"))).alias("year_row"),
        F.when(~F.col("is_year"), F.struct("l_partkey", "p_name", well_line.alias("line"))).alias("part_row"),
    )
    body = rows.groupBy("l_suppkey", "number").agg(
        F.sort_array(F.collect_list("year_row")).alias("years"),
        F.sort_array(F.collect_list("part_row")).alias("wells"),
        *[F.sum(m).alias(f"total_{m}") for m in month_names],
    )
    places = (
        table("supplier")
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "n_name", "r_name")
    )
    docs = places.join(body, F.col("s_suppkey") == F.col("l_suppkey"))

    year_lines = F.transform(F.col("years"), lambda y: y["line"])
    totals = [F.col(f"total_{m}") for m in month_names]
    broken = F.flatten(
        F.transform(
            year_lines,
            lambda l, i: F.when(
                _shows(n, "page_break") & (i == BREAK_AFTER),
                F.array(F.lit("Page 1 of 2"), F.concat(F.lit("\f"), l)),
            ).otherwise(F.array(l)),
        )
    )
    kind = F.when(n % 2 == 0, F.lit("Gas")).otherwise(F.lit("Oil"))
    text = F.concat(
        _optional(
            ~_shows(n, "no_county"),
            F.format_string("%s County; %s Quad; %s Field Pool", "n_name", "r_name", F.lit(POOL)),
        ),
        _optional(_shows(n, "junk_line"), F.lit(JUNK)),
        _optional(_shows(n, "lost_buyer") & ~_shows(n, "junk_line"), F.lit(JUNK), F.lit(JUNK), F.lit(JUNK)),
        F.array(
            F.concat(
                F.format_string("Buyer:  %s      Lease#: %s", "s_name", n.cast("string")),
                F.format_string("  Production  Type  %s  Production Unit", kind),
            )
        ),
        _optional(_shows(n, "blank_lines"), F.lit(""), F.lit("")),
        F.array(F.lit("Wells In Unit"), F.lit("Permit #      Well Name")),
        F.transform(F.col("wells"), lambda w: w["line"]),
        _optional(_shows(n, "null_permit"), F.lit(" " * 14 + "Unnumbered well")),
        F.array(F.lit("   Edit   Wells")),
        F.when(
            ~_shows(n, "no_table"),
            F.concat(
                F.array(F.lit(header_text())),
                broken,
                F.array(_row_text(F.lit("Totals"), [*totals, sum(totals[1:], totals[0])], n)),
            ),
        ).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("Page 1 of 1")),
    )
    value = F.when(_shows(n, "carriage_returns"), F.array_join(text, "\r\n")).otherwise(
        F.array_join(text, "\n")
    )
    return docs.select(F.col("number").alias("doc_id"), value.alias("value"))


def render_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c_custkey, by_well, by_permit)``: the two kinds of result page per customer.

    A customer without urgent orders has nothing to export; one with a negative balance
    has its list but no data table.  Orders are counted per priority first, so a
    page has one row per priority.  Links and boxes have the awkward attributes:
    quoted ``>``, names inside other values, character references.  Comments and scripts
    hold what looks like a title, a link, a box and a table.
    """
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_acctbal"
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderpriority")
    counts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.format_string("<tr><td>%s</td><td>%s</td></tr>", "o_orderpriority", F.col("n").cast("string"))
                )
            ),
            "\n",
        ).alias("rows"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.format_string(
                        "<option value='%s &amp; &#%d; &lt;&#x2192;>' title=\"a > b\" class=x>%s</option>",
                        "o_orderpriority", F.ascii(F.substring("o_orderpriority", 3, 1)), "o_orderpriority",
                    )
                )
            ),
            "",
        ).alias("options"),
    )
    joined = customer.join(rows, customer["c_custkey"] == rows["o_custkey"], "left")
    box = F.concat(F.lit("<select>"), F.coalesce("options", F.lit("")), F.lit("</select>"))
    listed = F.concat(box, F.lit("<table><tr><th>Well Name</th><th>Permit</th></tr></table>"))
    found = F.concat(F.lit("<table><tr><th>Well Name</th></tr>"), F.col("rows"), F.lit("</table>"))
    data = F.when(F.col("c_acctbal") >= 0, F.lit("<table><tr><th>Pool Name</th></tr></table>")).otherwise(F.lit(""))
    empty = F.lit("<table><tr><td>There are no production records for this well.</td></tr></table>")
    has = F.coalesce(F.col("urgent"), F.lit(False))
    link = F.format_string(
        "<a title=\"x>y href=no\" data-href='no' HREF = \"/c/%d?a=1&amp;b=&quot;%s&quot;&nope;\">more</a>",
        "c_custkey", F.translate("c_name", "#", "?"),
    )

    def page(body: Column) -> Column:
        return F.concat(
            F.lit(
                "<html><head><!-- <title>no</title> <a href='/no'> <form><tr><th>Well Name</th> -->"
                "<script>var s = '<select><option value=\"no\"></select><a href=\"/no\"><title>no</title>"
                "<form><tr><th>Pool Name</th></form>';</script><TITLE class='a>b'>\n Wells &amp; <b> of "
            ),
            F.translate("c_name", "#", "?"),
            F.lit("\t&#33; </title></head><body>"), link, F.lit("<form>"), body, F.lit("</form></body></html>"),
        )

    return joined.select(
        "c_custkey",
        page(F.when(has, F.concat(listed, found, data)).otherwise(listed)).alias("by_well"),
        page(F.when(has, F.concat(found, data)).otherwise(empty)).alias("by_permit"),
    )
