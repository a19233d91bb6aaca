"""Harvest work lists: what to fetch, from where to go on, under which names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import extension, progress_label, safe_file_name, stem
from reportlake.operators.numbering import running_total

MAX_ATTEMPTS = 3

# Outcomes of one attempt that end the work on an option.
FINAL_STATUSES = ["ok", "no_data", "not_found"]
FAILED = "failed"
PENDING = "pending"


def distinct_options(options: DataFrame, column: str = "option") -> DataFrame:
    """The different options; order them where they are written."""
    return options.select(column).distinct()


def option_counts(options: DataFrame, column: str = "option") -> DataFrame:
    """Different options and all options, as reported after reading a form.

    Counted per option first, so one option with most of the rows costs no more.
    """
    per_option = options.groupBy(column).agg(F.count(F.lit(1)).alias("copies"))
    return per_option.agg(
        F.count(column).alias("n_distinct"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("n_total"),
    )


def remaining(
    options: DataFrame, files: DataFrame, option: str = "option", file: str = "file_name"
) -> DataFrame:
    """Different options no saved file is named after (stem equals option)."""
    saved = files.select(stem(F.col(file)).alias("_stem")).distinct()
    wanted = options.select(option).distinct()
    return wanted.join(saved, wanted[option] == saved["_stem"], "left_anti")


def worklist_size(
    options: DataFrame, files: DataFrame, option: str = "option", file: str = "file_name"
) -> DataFrame:
    """Options left to load and options listed, in one row."""
    left = remaining(options, files, option, file).agg(F.count(F.lit(1)).alias("n_remaining"))
    total = options.agg(F.count(F.lit(1)).alias("n_listed"))
    return total.select("n_listed", left.scalar().alias("n_remaining"))


def resume_from(
    listed: DataFrame, start: str | None, option: str = "option", n: str = "n"
) -> DataFrame:
    """Entries from the first one equal to ``start`` on; none for an unknown name.

    An empty ``start`` keeps the whole list.
    """
    if not start:
        return listed
    first = listed.where(F.col(option) == start).agg(F.min(n))
    return listed.where(F.col(n) >= first.scalar())


def with_label(listed: DataFrame, option: str = "option", n: str = "n", width: int = 6) -> DataFrame:
    return listed.withColumn("label", progress_label(F.col(n), F.col(option), width))


def with_fallback(
    requested: DataFrame,
    available: DataFrame,
    option: str = "option",
    listed: str = "listed",
    position: str = "position",
) -> DataFrame:
    """Each request with the option to use: its own when available, else the first.

    ``available`` has options and their place; ``fell_back`` marks the others.
    """
    first = available.agg(F.min_by(listed, position))
    names = available.select(listed).distinct()
    joined = requested.join(names, requested[option] == names[listed], "left")
    return joined.select(
        *[requested[c] for c in requested.columns],
        F.coalesce(F.col(listed), first.scalar()).alias("chosen"),
        F.col(listed).isNull().alias("fell_back"),
    )


def attempt_rollup(
    attempts: DataFrame,
    option: str = "option",
    attempt: str = "attempt",
    status: str = "status",
) -> DataFrame:
    """Outcome per option from a log of attempts.

    Work on an option ends with its first final status, or fails when
    ``MAX_ATTEMPTS`` attempts ended in something else; later entries of the log
    are ignored.  The rank filter is applied before the shuffle as well, so an
    option with most of the log sends a few rows per task.
    """
    order = Window.partitionBy(option).orderBy(attempt)
    first = (
        attempts.select(option, attempt, status)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= MAX_ATTEMPTS)
    )
    final = F.col(status).isin(FINAL_STATUSES)
    grouped = first.groupBy(option).agg(
        F.min(F.when(final, F.col("_rank"))).alias("_ended"),
        F.min_by(status, F.when(final, F.col("_rank"))).alias("_status"),
        F.max("_rank").alias("_seen"),
    )
    return grouped.select(
        option,
        F.when(F.col("_ended").isNotNull(), F.col("_status"))
        .when(F.col("_seen") >= MAX_ATTEMPTS, F.lit(FAILED))
        .otherwise(F.lit(PENDING))
        .alias("outcome"),
        F.coalesce("_ended", "_seen").cast("bigint").alias("n_attempts"),
    )


_NUMBERED = r"(?s)^(.*)_\(([1-9]\d{0,17})\)$"


def _taken(names: DataFrame) -> DataFrame:
    """``(stem, ext, number)`` each given file name uses up: number 0 of its own
    family, and number N of the shorter one when it ends in ``_(N)``."""
    file = F.col("name")
    whole, ext = stem(file), extension(file)
    own = F.struct(whole.alias("stem"), ext.alias("ext"), F.lit(0).cast("bigint").alias("number"))
    shorter = F.struct(
        F.regexp_extract(whole, _NUMBERED, 1).alias("stem"),
        ext.alias("ext"),
        F.regexp_extract(whole, _NUMBERED, 2).try_cast("bigint").alias("number"),
    )
    both = F.when(whole.rlike(_NUMBERED), F.array(own, shorter)).otherwise(F.array(own))
    return names.select(F.inline(both))


def plan_file_names(
    requests: DataFrame,
    existing: DataFrame,
    option: str = "option",
    ext: str = "ext",
    n: str = "n",
    file: str = "file_name",
) -> DataFrame:
    """A free file name for every request, in list order.

    A request is named after its option, made safe.  The first free of ``name``,
    ``name_(1)``, ``name_(2)`` ... is taken, existing files and the plain names
    of other requests counting as used.  Asked names that nothing competes for
    keep their plain form.

    The free number of the r-th request of a name is r plus the used numbers
    below it.  Written with f(i) = used(i) - i, the free places before the i-th
    used number, that is r plus the count of f(i) <= r: one running total over
    requests and used numbers together.
    """
    asked = requests.select(
        F.col(n).alias("_n"), F.col(option).alias("_option"), safe_file_name(F.col(option)).alias("stem"), F.col(ext).alias("ext")
    )
    families = asked.select("stem", "ext").distinct()
    used = _taken(existing.select(F.col(file).alias("name")))
    plain = families.select(F.concat("stem", "ext").alias("name"))
    # A plain request uses its own number 0 itself; only the shorter name loses one.
    crossing = _taken(plain).where(F.col("number") > 0)
    used = used.unionByName(crossing).distinct().join(families, ["stem", "ext"], "left_semi")
    totals = _numbers(asked, used.select("stem", "ext", F.col("number").alias("first"), F.col("number").alias("last")))
    return totals.select(
        F.col("_n").cast(requests.schema[n].dataType).alias(n),
        F.col("_option").alias(option),
        "number",
        _name().alias(file),
    )


def _name() -> Column:
    """The file name of a number of a family."""
    suffix = F.when(F.col("number") > 0, F.format_string("_(%d)", "number")).otherwise(F.lit(""))
    return F.concat("stem", suffix, "ext")


def _numbers(asked: DataFrame, used: DataFrame) -> DataFrame:
    """``asked`` with ``number``, the free one each takes; ``used`` holds runs ``first`` to ``last`` that share no number."""
    # one running total for both: each request among its name's requests, the numbers used up to each run
    length = F.coalesce(F.col("last") - F.col("first") + 1, F.lit(1))
    both = asked.select("stem", "ext", F.lit(1).alias("kind"), F.col("_n").cast("bigint").alias("first"), "_n", "_option").unionByName(
        used.select("stem", "ext", F.lit(0).alias("kind"), "first", "last"), allowMissingColumns=True
    )
    ranked = running_total(both.withColumn("_length", length), ["stem", "ext", "kind"], "first", F.col("_length"), "_order")
    steps = (
        ranked.where("kind = 0")
        .select("stem", "ext", (F.col("first") - F.col("_order") + F.col("_length")).alias("_place"), "_length")
        .groupBy("stem", "ext", "_place")
        .agg(F.sum("_length").alias("_used"))
    )
    # Used numbers come before the request of the same place.
    points = steps.select("stem", "ext", (F.col("_place") * 2).alias("_point"), "_used").unionByName(
        ranked.where("kind = 1").select(
            "stem", "ext", (F.col("_order") * 2 - 1).alias("_point"), F.lit(0).alias("_used"), "_n", "_option"
        ),
        allowMissingColumns=True,
    )
    totals = running_total(points, ["stem", "ext"], "_point", F.col("_used"), "_below").where("_point % 2 = 1")
    return totals.withColumn("number", F.shiftright("_point", 1) + F.col("_below"))
