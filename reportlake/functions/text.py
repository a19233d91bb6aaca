"""File names, paths, URLs and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.cells import hash_cleanup

__all__ = [
    "hash_cleanup", "null_to_text", "has_null", "safe_file_name", "option_url",
    "dataset_folder", "base_name", "stem", "extension", "fill_placeholders", "progress_label",
]

# Fixed value: characters a file name keeps, besides Unicode letters, digits and spaces.
_KEPT = r"_\-+#&,;.()'"
UNSAFE_RUN = rf"[^\t-\r\x1c-\x1f\x85\p{{Z}}\p{{L}}\p{{N}}{_KEPT}]+"

_SPLIT_EXTENSION = r"(?s)^(.*[^.].*)(\.[^.]*)$"


def has_null(values: list[Column]) -> Column:
    """Any value is null: the row has bad parameters."""
    bad = F.lit(False)
    for value in values:
        bad = bad | value.isNull()
    return bad


def null_to_text(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def safe_file_name(text: Column) -> Column:
    """Every run of characters a file name cannot hold becomes one underscore."""
    return F.regexp_replace(text, UNSAFE_RUN, "_")


def option_url(base: str | Column, option: Column) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) else base, option)


def dataset_folder(url: Column, suffix: str = "", cut_at: str | None = None) -> Column:
    """Folder name of a harvested site: no scheme, ``/`` as ``-``, then a suffix.

    With ``cut_at`` everything from its first occurrence on is dropped first.
    """
    head = F.substring_index(url, cut_at, 1) if cut_at else url
    at = F.instr(head, "://")
    rest = F.when(at > 0, F.substr(head, at + 3)).otherwise(F.lit(""))
    return F.concat(F.translate(rest, "/", "-"), F.lit(suffix))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its extension; leading dots are no extension."""
    name = base_name(path)
    return F.when(name.rlike(_SPLIT_EXTENSION), F.regexp_extract(name, _SPLIT_EXTENSION, 1)).otherwise(name)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), _SPLIT_EXTENSION, 2)


def fill_placeholders(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``<name>`` by its value for every given name."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


def progress_label(n: Column, option: Column, width: int = 6) -> Column:
    """Right-aligned running number and name: six wide for options, three for files."""
    return F.format_string(f"%{width}d. %s ", n, option)
