"""Predicates and extractions over stored HTML pages."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that tell the kinds of result pages apart.
WELL_NAME_HEADER = "Well Name"
POOL_NAME_HEADER = "Pool Name"
NO_RECORDS = "There are no production records for this well."

# Elements whose content is text whatever it looks like; that of the last two is shown.
_HIDDEN = "script|style|xmp|iframe|noembed|noframes"
_RAW = f"{_HIDDEN}|textarea|title"
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>]++)?+"""
_ATTRIBUTES = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+"
# One token of a page: a comment, an element of raw text up to its end tag, a tag, or text. Every way ends
# at the end of the page at the latest, so a page is read once whatever is left open in it.
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?=</\1[\s/>]|\z)|\z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z)"
    r"|<[!?/][^>]*+(?:>|\z)|[^<]++|<"
)
_TAG = rf"(?is)^</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
# What stands for < and > that belong to no tag: characters that no text may hold.
_MASKED, _PLAIN = "\ufdd0\ufdd1", "<>"


def scanned(html: Column) -> Column:
    """The page as a parser reads it: without comments and scripts, and with ``<`` and ``>`` around tags only.

    Others (in values, titles, text) are masked and come back by :func:`shown`. A tag that the end of the
    page cuts off is none.
    """

    def token(t: Column) -> Column:
        tag = F.regexp_substr(t, F.lit(_TAG))
        size = F.char_length(tag)
        masked = F.translate(F.substr(t, F.lit(2), size - 2), _PLAIN, _MASKED)
        rest = F.substr(t, size + 1)
        hidden = t.rlike(rf"(?i)^<(?:{_HIDDEN})[\s/>]")
        text = F.when(hidden, F.lit("")).otherwise(F.translate(rest, _PLAIN, _MASKED))
        # most tokens are texts or tags without any such character
        return (
            F.when(~t.startswith("<"), F.when(t.contains(">"), F.translate(t, _PLAIN, _MASKED)).otherwise(t))
            .when(t.rlike(r"^</?[A-Za-z][^<>]*+>$"), t)
            .when(tag.isNotNull(), F.concat(F.lit("<"), masked, F.lit(">"), text))
            .when(t.rlike(r"(?i)^<[!?/a-z]"), F.lit(""))
            .otherwise(F.translate(t, _PLAIN, _MASKED))
        )

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), token), "")


def shown(text: Column) -> Column:
    """Text or a value out of a scanned page: masks taken off, character references decoded."""
    return unescape(F.translate(text, _MASKED, _PLAIN))


def _with(value: Column, make) -> Column:
    """``make`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _attributes(page: Column, tag: str) -> Column:
    """For every tag of a kind the array of its attributes, a struct of name and value each."""
    pattern = F.lit(rf"(?i)<{tag}(?=[\s/>])([^>]*)>")
    found = rf"(?is)({_NAME})(?:\s*+=\s*+({_VALUE}))?+"
    quoted = r"""(?s)^(?:"([^"]*)"?|'([^']*)'?|(.*))$"""

    def attribute(text: Column) -> Column:
        value = F.regexp_extract(text, r"(?s)^[^\s/>][^\s/>=]*+\s*+=\s*+(.*)$", 1)
        return F.struct(
            F.lower(F.regexp_extract(text, rf"(?s)^({_NAME})", 1)).alias("name"),
            F.concat(*[F.regexp_extract(value, quoted, i) for i in (1, 2, 3)]).alias("value"),
        )

    tags = F.regexp_extract_all(page, pattern, F.lit(1))
    return F.transform(tags, lambda t: F.transform(F.regexp_extract_all(t, F.lit(found), F.lit(0)), attribute))


def attribute_values(html: Column, tag: str, name: str) -> Column:
    """All values of one attribute of one kind of tag, in page order; the first one of a tag counts."""
    own = F.transform(_attributes(scanned(html), tag), lambda x: F.get(F.filter(x, lambda a: a["name"] == name), F.lit(0))["value"])
    return F.transform(F.array_compact(own), shown)


def option_values(html: Column) -> Column:
    """The first attribute of every ``option`` that stands directly in a ``select``."""

    def values(page: Column) -> Column:
        boxes = F.regexp_extract_all(page, F.lit(r"(?is)<select(?=[\s/>])[^>]*>(.*?)(?:</select(?=[\s/>])|\z)"), F.lit(1))
        direct = F.regexp_replace(F.array_join(boxes, "\n"), r"(?is)<optgroup(?=[\s/>]).*?(?:</optgroup(?=[\s/>])[^>]*>|\z)", "")
        listed = F.filter(_attributes(direct, "option"), lambda x: F.size(x) > 0)
        return F.transform(listed, lambda x: shown(F.get(x, F.lit(0))["value"]))

    return _with(scanned(html), values)


def unescape(text: Column) -> Column:
    """Named and numeric character references decoded, each once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, code)])
    names = F.map_concat(names, F.create_map(F.lit("apos"), F.lit(39)))

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (
            F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, 6), 16, 10).cast("int"))
            .when(name.startswith("#"), F.substring(name, 2, 7).cast("int"))
            .otherwise(F.get(F.array(F.element_at(names, name)), F.lit(0)))
        )
        bad = (code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        code = F.when(bad, F.lit(0xFFFD)).otherwise(code)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        rest = F.substring(part, F.char_length(name) + 2, F.char_length(part))
        return F.when((name != "") & code.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    after = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(after, ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def title(html: Column) -> Column:
    """The page's title: white space at its ends goes, inside it counts as one space; empty if there is none."""
    found = F.regexp_extract(scanned(html), r"(?is)<title(?=[\s/>])[^>]*>([^<]*)", 1)
    return F.btrim(F.regexp_replace(shown(found), r"[ \t\n\f\r]+", " "), F.lit(" "))


def is_page(html: Column, url: Column, token: str, option: Column) -> Column:
    """The title holds the token and the address holds the option asked for."""
    return title(html).contains(token) & url.contains(option)


def _rows_with_cell(page: Column, cell: str, text: str, in_form: bool = False) -> Column:
    """Number of table rows of a scanned page that hold a ``td``/``th`` with exactly this text."""
    if in_form:
        forms = F.regexp_extract_all(page, F.lit(r"(?is)<form(?=[\s/>])[^>]*>(.*?)(?:</form(?=[\s/>])|\z)"), F.lit(1))
        page = F.array_join(forms, "\n")
    # What comes before the first row belongs to none.
    rows = F.slice(F.split(page, r"(?i)<tr(?=[\s/>])"), F.lit(2), F.lit(2**30))
    pattern = F.lit(rf"(?is)<{cell}(?=[\s/>])[^>]*>(.*?)(?=</{cell}[\s/>]|<t[dhr][\s/>]|\z)")

    def holds(row: Column) -> Column:
        cells = F.transform(
            F.regexp_extract_all(row, pattern, F.lit(1)), lambda c: shown(F.regexp_replace(c, r"<[^>]*>", ""))
        )
        return F.array_contains(cells, F.lit(text))

    return F.size(F.filter(rows, holds))


def rows_with_cell(html: Column, cell: str, text: str, in_form: bool = False) -> Column:
    """Number of table rows that hold a ``td``/``th`` with exactly this text."""
    return _with(scanned(html), lambda page: _rows_with_cell(page, cell, text, in_form))


def _no_wells(page: Column) -> Column:
    return _rows_with_cell(page, "th", WELL_NAME_HEADER, in_form=True) == 1


def _no_records(page: Column) -> Column:
    found = _rows_with_cell(page, "td", NO_RECORDS) > 0
    # the sentence may be written with references
    return F.when(page.contains(NO_RECORDS) | page.contains("&"), found).otherwise(F.lit(False))


def _data_table(page: Column) -> Column:
    return _rows_with_cell(page, "th", POOL_NAME_HEADER, in_form=True) > 0


def has_no_wells(html: Column) -> Column:
    """Listed by well: exactly one well table means there is nothing to export."""
    return _with(scanned(html), _no_wells)


def has_no_records(html: Column) -> Column:
    """Listed by permit: the page says so."""
    return _with(scanned(html), _no_records)


def has_data_table(html: Column) -> Column:
    return _with(scanned(html), _data_table)


def page_state(html: Column, by_well: bool) -> Column:
    """``no_data``, ``data`` or ``no_table``; no data is decided first."""

    def state(page: Column) -> Column:
        empty = _no_wells(page) if by_well else _no_records(page)
        return F.when(empty, F.lit("no_data")).when(_data_table(page), F.lit("data")).otherwise(F.lit("no_table"))

    return _with(scanned(html), state)
