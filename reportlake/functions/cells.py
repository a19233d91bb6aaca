"""The wide year row: ``Year``, twelve month cells and a ``Totals`` cell.

The row grammar allows blank cells, ``#`` filler and gaps of many spaces.  Tried
as one backtracking expression it is exponential on damaged rows, so the work is
split.  A possessive expression decides the ordinary row (fourteen clean tokens)
in one linear pass.  Only rows that miss it go through interval arithmetic over
their gaps: for every gap the least and the largest number of column separators
it can hold are counted, which settles both whether the row matches and which
cell every value falls in.

Three layouts turn tokens into cells:

* ``pack_left`` is the grammar taken literally: ``#`` is filler, a missing month
  moves later values left and the blank lands as late as it can;
* ``columns`` keeps every token, masked ones too, under its own column, by
  counting when all thirteen are there and by header position when some are not;
* ``touching`` is an older grammar in which a ``#`` alone may border two cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of the wide row, in column order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
YEAR = "Year"
TOTALS = "Totals"
CELLS = [*MONTHS, TOTALS]
WIDE_FIELDS = [YEAR, *CELLS]

# Width limits of the wide row.
YEAR_DIGITS = "2,4"
MONTH_WIDTH = 9
TOTALS_WIDTH = 10
FILLER_WIDTH = 9
SPACES_WIDTH = 17
TAIL_WIDTH = 10

N_CELLS = len(CELLS)
_GAP = FILLER_WIDTH + SPACES_WIDTH
_NUM = r"[\p{Nd}.]"
_ASCII_NUM = "[0123456789.]"
_START = rf"^[^\p{{Nd}}T]*+(?:\p{{Nd}}{{{YEAR_DIGITS}}}|{TOTALS})"

# A row with fourteen clean ASCII tokens; every quantifier is possessive or bounded.
PLAIN_ROW = (
    rf"^[ \f]*+(?:[0-9]{{{YEAR_DIGITS}}}+|{TOTALS})"
    rf"(?: {{1,{_GAP}}}+{_ASCII_NUM}{{1,{MONTH_WIDTH}}}+){{{len(MONTHS)}}}"
    rf" {{1,{_GAP}}}+{_ASCII_NUM}{{1,{TOTALS_WIDTH}}}+ {{0,{TAIL_WIDTH}}}+\z"
)
# Anything that could be a row: year or total, a gap, then only cell characters.
ROW_GUARD = rf"{_START}(?=[# ])[\p{{Nd}}.# ]*+\z"
# What every row begins with, whatever its cells are.
ROW_START = rf"{_START}(?=[# ])"
# Enough gaps for every column and no more tokens than columns.
COLUMN_ROW = (
    rf"{_START}(?=[# ])(?=(?:[^ ]*+ ){{{N_CELLS}}})#*+"
    rf"(?: ++[\p{{Nd}}.#]++){{0,{N_CELLS}}}+ *+\z"
)
# The older strict grammar: every cell numeric.
NUMERIC_ROW = rf"{_START}(?: ++{_NUM}++){{{N_CELLS}}} *+\z"
_HEAD = rf"^([^\p{{Nd}}T]*+(\p{{Nd}}{{{YEAR_DIGITS}}}|{TOTALS}))([\p{{Nd}}.# ]*+)\z"
_SEPARATOR = rf"(?>[# ]{{0,{FILLER_WIDTH}}} {{1,{SPACES_WIDTH}}})"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + of(x))


def _n_spaces(gap: Column) -> Column:
    return F.length(gap) - F.length(F.replace(gap, F.lit(" "), F.lit("")))


def _n_separators(gap: Column) -> Column:
    return F.regexp_count(gap, F.lit(_SEPARATOR)).cast("int")


def year_of(line: Column) -> Column:
    return F.regexp_extract(line, _HEAD, 2)


def _body(line: Column) -> Column:
    return F.regexp_extract(line, _HEAD, 3)


def _layout(body: Column) -> Column:
    """Tokens, inner gaps (each before a token) and the trailing gap of a row."""
    gaps = F.split(body, rf"{_NUM}+")
    return F.struct(
        F.filter(F.split(body, "[# ]+"), lambda t: t != "").alias("tokens"),
        F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("inner"),
        F.element_at(gaps, -1).alias("tail"),
    )


def _long_last(row: Column) -> Column:
    last = F.get(row["tokens"], F.size(row["tokens"]) - 1)
    return F.coalesce(F.length(last) > MONTH_WIDTH, F.lit(False))


def _tail_min(tail: Column) -> Column:
    """Fewest separators that leave a tail no longer than the grammar allows."""
    more = F.regexp_count(tail, F.lit(rf"{_SEPARATOR}(?=[# ]{{{TAIL_WIDTH + 1}}})"))
    return F.when(F.length(tail) <= TAIL_WIDTH, F.lit(0)).otherwise(more.cast("int") + 1)


def _tail_max(row: Column) -> Column:
    return F.when(_long_last(row), F.lit(0)).otherwise(_n_spaces(row["tail"]))


def _feasible(row: Column) -> Column:
    n = F.size(row["tokens"])
    inner_ok = F.forall(
        row["inner"],
        lambda g: g.endswith(" ") & ~g.rlike(f"#{{{FILLER_WIDTH + 1}}}"),
    )
    widths_ok = F.forall(
        F.transform(
            row["tokens"],
            lambda t, i: F.length(t)
            <= F.when(i == n - 1, F.lit(TOTALS_WIDTH)).otherwise(F.lit(MONTH_WIDTH)),
        ),
        lambda ok: ok,
    )
    tail = row["tail"]
    tail_ok = ~tail.rlike(f"#{{{FILLER_WIDTH + 1},}} ") & ~tail.rlike(f"#{{{TAIL_WIDTH + 1},}}\\z")
    low = _total(row["inner"], _n_separators)
    high = _total(row["inner"], _n_spaces)
    return (
        inner_ok
        & widths_ok
        & tail_ok
        & (_tail_min(tail) <= _tail_max(row))
        & (low + _tail_min(tail) <= N_CELLS)
        & (high + _tail_max(row) >= N_CELLS)
    )


def _fits(line: Column) -> Column:
    """The literal grammar for rows that are not plain."""
    return let(_layout(_body(line)), _feasible)


def is_packed_row(line: Column) -> Column:
    """The row grammar taken literally, decided in linear time."""
    return (
        F.when(~line.rlike(ROW_START), F.lit(False))
        .when(line.rlike(PLAIN_ROW), F.lit(True))
        .when(line.rlike(ROW_GUARD) & ~line.rlike(r"#[\p{Nd}.]"), _fits(line))
        .otherwise(F.lit(False))
    )


def is_column_row(line: Column) -> Column:
    """Rows of the ``columns`` layout: all packed rows, and rows with masked cells."""
    # most lines are of another kind, and one look at their beginning tells
    return (
        F.when(~line.rlike(ROW_START), F.lit(False))
        .when(line.rlike(PLAIN_ROW), F.lit(True))
        .when(line.rlike(COLUMN_ROW), F.lit(True))
        .when(line.rlike(ROW_GUARD) & ~line.rlike(r"#[\p{Nd}.]"), _fits(line))
        .otherwise(F.lit(False))
    )


def is_numeric_row(line: Column) -> Column:
    return line.rlike(NUMERIC_ROW)


def _spread(tokens: Column, column_of: Column) -> Column:
    """Thirteen cells from tokens and their one-based columns; blanks are ``''``."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(N_CELLS)),
        lambda c: F.coalesce(
            F.get(tokens, F.array_position(column_of, c).cast("int") - 1), F.lit("")
        ),
    )


def _packed(row: Column) -> Column:
    """Earliest gaps take the fewest separators, so blanks come as late as they can."""
    spans = F.transform(
        row["inner"],
        lambda g: F.struct(_n_separators(g).alias("low"), _n_spaces(g).alias("high")),
    )
    zero = F.struct(
        F.lit(0).alias("at"),
        (_total(row["inner"], _n_spaces) + _tail_max(row)).alias("room"),
        F.array().cast("array<int>").alias("columns"),
    )

    def step(acc: Column, gap: Column) -> Column:
        room = acc["room"] - gap["high"]
        at = F.greatest(acc["at"] + gap["low"], F.lit(N_CELLS) - room)
        return F.struct(
            at.alias("at"),
            room.alias("room"),
            F.concat(acc["columns"], F.array(at)).alias("columns"),
        )

    return let(
        F.aggregate(spans, zero, step, lambda acc: acc["columns"]),
        lambda columns: _spread(row["tokens"], columns),
    )


def _split_row(line: Column) -> Column:
    """Year and cell tokens, when nothing but spaces comes before the year."""
    return F.split(F.btrim(line, F.lit(" \f")), " +")


def _is_whole(tokens: Column) -> Column:
    """Fourteen tokens of a matching row, the first being the year alone: what may
    stand before the year holds neither digits nor a T."""
    first = F.get(tokens, F.lit(0))
    code = F.ascii(first)
    begins = ((code >= ord("0")) & (code <= ord("9"))) | (code == ord(TOTALS[0]))
    return (F.size(tokens) == N_CELLS + 1) & begins & ~first.contains("#")


def _space_tokens(body: Column) -> Column:
    """Tokens between spaces; ``#`` touching the year belongs to no cell."""
    clean = F.when(body.startswith("#"), F.regexp_replace(body, "^#+", "")).otherwise(body)
    return F.array_remove(F.split(clean, " +"), "")


def _with_year(line: Column, cells: Column) -> Column:
    return F.concat(F.array(year_of(line)), cells)


def packed_row(line: Column) -> Column:
    """Fourteen texts of a matching row in the ``pack_left`` layout."""
    return F.when(line.rlike(PLAIN_ROW), _split_row(line)).otherwise(
        _with_year(line, let(_layout(_body(line)), _packed))
    )


def header_places(header: Column) -> Column:
    """Where the columns lie, from the header line: label centres, doubled, and the
    first character of each column's zone, zones meeting halfway between centres."""
    # labels as an array, not thirteen expressions: the code around them stays short enough to be compiled
    names = F.array(*[F.lit(name) for name in CELLS])
    label = F.transform(names, lambda name: F.instr(header, name) * 2 + F.length(name) - 1)

    def places(centres: Column) -> Column:
        starts = F.transform(
            F.slice(centres, F.lit(1), F.lit(N_CELLS - 1)),
            lambda a, i: F.ceil((a + F.get(centres, i + 1)) / 4).cast("int"),
        )
        return F.struct(centres.alias("centres"), starts.alias("starts"))

    return F.when(header.isNotNull(), let(label, places))


def _zones(line: Column, end: Column, places: Column) -> Column:
    """Texts of the thirteen zones; null unless every token lies in a zone of its own.

    ``end`` is where the year ends.  A run of ``#`` may cross zones: it masks
    every column it covers.
    """
    first = end + 1
    starts = [first] + [F.get(places["starts"], F.lit(i)) for i in range(N_CELLS - 1)]
    ends = starts[1:] + [F.length(line) + 1]
    texts = [F.trim(F.substr(line, a, F.greatest(b - a, F.lit(0)))) for a, b in zip(starts, ends)]
    clean = starts[1] >= first
    for text in texts:
        clean = clean & ~text.contains(" ")
    for start in starts[1:]:
        seam = F.substr(line, start - 1, F.lit(2))
        clean = clean & (seam.contains(" ") | (seam == "##") | (F.length(seam) < 2))
    return F.when(clean, F.array(*texts))


def _nearest(line: Column, end: Column, places: Column) -> Column:
    """Cells by the label nearest to each token; null unless every token has its own."""
    pieces = F.regexp_extract_all(_body(line), F.lit(r"( *+[^ ]++)"), F.lit(1))

    def centre(parts: Column, i: Column) -> Column:
        last = end + _total(F.slice(parts, F.lit(1), i + 1), F.length)
        return 2 * last - F.length(F.ltrim(F.get(parts, i))) + 1

    def column(parts: Column, i: Column) -> Column:
        return let(
            centre(parts, i),
            lambda c: let(
                F.transform(places["centres"], lambda x: F.abs(x - c)),
                lambda away: F.array_position(away, F.array_min(away)).cast("int"),
            ),
        )

    def cells(parts: Column) -> Column:
        return let(
            F.transform(parts, lambda _, i: column(parts, i)),
            lambda at: F.when(
                F.size(F.array_distinct(at)) == F.size(at),
                _spread(F.transform(parts, lambda p: F.ltrim(p)), at),
            ),
        )

    return let(pieces, cells)


def _uneven(line: Column, head: Column, places: Column) -> Column:
    """Thirteen cells of a row whose tokens do not simply follow the year.

    With tokens missing: by zone, by nearest label, or packed to the left.
    ``head`` holds the end of the year and the tokens after it.
    """
    tokens = head["tokens"]
    packs = line.rlike(ROW_GUARD) & ~line.rlike(r"#[\p{Nd}.]") & _fits(line)
    packed = let(_layout(_body(line)), _packed)
    in_order = F.transform(
        F.sequence(F.lit(0), F.lit(N_CELLS - 1)),
        lambda i: F.coalesce(F.get(tokens, i), F.lit("")),
    )
    by_place = F.when(places.isNotNull(), _zones(line, head["end"], places))
    by_label = F.when(places.isNotNull(), _nearest(line, head["end"], places))
    left = F.when(packs, packed).otherwise(in_order)
    return (
        F.when(F.size(tokens) == N_CELLS, tokens)
        .when(F.size(tokens) < N_CELLS, F.coalesce(by_place, by_label, left))
        .otherwise(packed)
    )


def _head_of(line: Column) -> Column:
    return F.struct(
        F.length(F.regexp_extract(line, _HEAD, 1)).alias("end"),
        F.array(year_of(line)).alias("year"),
        _space_tokens(_body(line)).alias("tokens"),
    )


def column_row(line: Column, places: Column) -> Column:
    """Fourteen raw texts of a matching row, ``#`` kept, each under its own column."""

    def uneven(head: Column) -> Column:
        return F.concat(head["year"], _uneven(line, head, places))

    return let(
        _split_row(line),
        lambda tokens: F.when(_is_whole(tokens), tokens).otherwise(let(_head_of(line), uneven)),
    )


def with_column_row(rows: DataFrame, line: Column, places: Column, name: str) -> DataFrame:
    """The same as a column of a table, in steps that Spark compiles."""
    tokens, head = F.col("_tokens"), F.col("_head")
    rows = rows.withColumn("_tokens", _split_row(line))
    rows = rows.withColumn("_head", F.when(~_is_whole(tokens), _head_of(line)))
    uneven = F.concat(head["year"], _uneven(line, head, places))
    return rows.withColumn(name, F.when(head.isNull(), tokens).otherwise(uneven)).drop(
        "_tokens", "_head"
    )


# Widths of the older row whose cells may touch.
TOUCHING_SPACES = 13
_UNIT = (
    rf"[0-9.]{{1,{MONTH_WIDTH}}}+#{{0,{FILLER_WIDTH}}}+ {{0,{TOUCHING_SPACES}}}+"
    rf"|#{{1,{FILLER_WIDTH}}}+ {{0,{TOUCHING_SPACES}}}+| {{1,{TOUCHING_SPACES}}}+"
)
_LAST = rf"(?:^|(?<=[# ]))([0-9.]{{1,{TOTALS_WIDTH}}}+)#{{0,{TOTALS_WIDTH}}}\z"


def _touching(line: Column, made) -> Column:
    """What ``made`` gives of the units and the last number of a row in which spaces, or ``#`` alone, end a cell; null for no row.

    A mask or an overlong gap is a cell without digits.  The last number is the total; with fewer
    cells than columns the empty ones come before it.
    """
    body = F.regexp_replace(F.regexp_extract(line, _HEAD, 3), rf"^ {{1,{TOUCHING_SPACES}}}+", "")

    def parts(text: Column) -> Column:
        return F.struct(F.regexp_replace(text, _LAST, "").alias("months"), F.regexp_extract(text, _LAST, 1).alias("last"))

    def row(found: Column) -> Column:
        months, last = found["months"], found["last"]
        return let(
            F.regexp_extract_all(months, F.lit(_UNIT), F.lit(0)),
            lambda units: F.when(
                (F.array_join(units, "") == months) & (F.size(units) <= len(MONTHS)) & (last != ""), made(units, last)
            ),
        )

    return F.when(line.rlike(_HEAD), let(let(body, parts), row))


def _touching_cells(line: Column) -> Column:
    """The thirteen cells of such a row."""
    return _touching(
        line,
        lambda units, last: F.concat(
            F.transform(units, lambda u: F.regexp_extract(u, "^[0-9.]*", 0)),
            F.array_repeat(F.lit(""), F.lit(len(MONTHS)) - F.size(units)),
            F.array(last),
        ),
    )


def is_touching_row(line: Column) -> Column:
    # whether it is one needs no cells
    return _touching(line, lambda units, last: F.lit(True)).isNotNull()


def touching_row(line: Column) -> Column:
    """Year and cells of a row that :func:`is_touching_row`."""
    return F.concat(F.array(year_of(line)), _touching_cells(line))


def hash_cleanup(value: Column) -> Column:
    """Drop every ``#`` from a value that also holds a digit; leave others alone."""
    return F.when(
        value.contains("#") & value.rlike(r"\p{Nd}"), F.replace(value, F.lit("#"), F.lit(""))
    ).otherwise(value)
