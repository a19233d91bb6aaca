"""Report plans: which line grammars a document goes through, in which order."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import cells
from reportlake.plans.dialect import Pattern, compile_pattern

FILE_FIELD = "File"
MARKER_FIELD = "nodata"


@dataclass(frozen=True)
class Grammar:
    """A line grammar given as a pattern with named groups.

    ``needs`` lists literals every matching line contains; they are looked for
    first, which is far cheaper than the pattern on lines of another kind.
    """

    name: str
    pattern: str
    needs: tuple[str, ...] = ()

    @cached_property
    def compiled(self) -> Pattern:
        return compile_pattern(self.pattern)

    @property
    def fields(self) -> list[str]:
        return list(self.compiled.groups)

    @property
    def wide(self) -> bool:
        """A monthly table row, whose cells may be masked."""
        return False

    @property
    def loose(self) -> bool:
        """Some named group may take no part in a match."""
        return bool(self.compiled.optional)

    @property
    def quick(self) -> bool:
        """Its test costs so little that every line can be marked with it."""
        return False

    def _guarded(self, line: Column, test: Column) -> Column:
        for literal in reversed(self.needs):
            test = F.when(line.contains(literal), test).otherwise(F.lit(False))
        return F.coalesce(test, F.lit(False))

    def matches(self, line: Column) -> Column:
        """The pattern matches at the line start."""
        return self._guarded(line, line.rlike(self.compiled.java))

    def all_present(self, line: Column) -> Column:
        """It matches and every named group took part."""
        return self._guarded(line, line.rlike(self.compiled.all_present))

    def group(self, line: Column, name: str) -> Column:
        """Text of one named group of a matching line; null when it took no part."""
        text = F.regexp_extract(line, self.compiled.java, self.compiled.groups[name])
        presence = self.compiled.optional.get(name)
        return F.when(line.rlike(presence), text) if presence else text

    def prepare(self, header: Column) -> Column:
        """What ``parse`` needs from the table's header line, worked out once a document."""
        return F.lit(True)

    def parse(self, line: Column, header: Column | None = None) -> Column:
        """The parsed line; ``header`` is what ``prepare`` made of the header line."""
        if not self.fields:
            return F.struct(F.lit(True).alias("matched"))
        return F.struct(*[self.group(line, f).alias(f) for f in self.fields])

    def parse_entry(self, line: Column) -> Column:
        """``parse`` of a line that a lambda holds already."""
        return self.parse(line)

    def with_parsed(self, rows: DataFrame, line: str, header: str, name: str) -> DataFrame:
        """A table of matching lines with the parsed line as a further column."""
        return rows.withColumn(name, self.parse(F.col(line), F.col(header)))

    def joined(self, lines: Column, name: str, separator: str, absent: str) -> Column:
        """The texts of one named group in an array of matching lines, joined; ``absent`` for a null."""
        texts = F.transform(lines, lambda line: F.coalesce(self.group(line, name), F.lit(absent)))
        return F.array_join(texts, separator)

    def values(self, parsed: Column) -> dict[str, Column]:
        return {f: parsed[f] for f in self.fields}

    def cleaned(self, parsed: Column, line: Column) -> Column:
        """The parsed line with nulls as text and ``#`` taken out of mixed values."""
        values = self.values(parsed)
        if not values:
            return parsed
        return F.struct(
            *[
                cells.hash_cleanup(F.coalesce(v, F.lit("None"))).alias(n)
                for n, v in values.items()
            ]
        )

    def texts(self, cleaned: Column) -> dict[str, Column]:
        return {f: cleaned[f] for f in self.fields}

    def masked(self, parsed: Column) -> Column:
        return F.array().cast("array<string>")


def _mask_off(text: Column) -> Column:
    """The digits of a cell, nothing if it is all mask."""
    # asked once for each question: thirteen cells make a method that the JVM may find too long to compile
    digits = F.when(text.rlike(r"\p{Nd}"), F.replace(text, F.lit("#"), F.lit(""))).otherwise(F.lit(""))
    return F.when(text.contains("#"), digits).otherwise(text)


@dataclass(frozen=True)
class WideRow(Grammar):
    """The monthly table row.  ``layout`` and ``mask_mode`` as in ``functions.cells``.

    ``mask_mode`` says what a cell of nothing but ``#`` becomes in the ``columns`` layout:
    ``blank`` leaves it out, ``keep`` keeps its text, ``reject`` refuses a row with any ``#``.
    A cell that holds digits as well loses its ``#``.
    """

    pattern: str = ""
    layout: str = "columns"
    mask_mode: str = "blank"

    def __post_init__(self) -> None:
        if self.layout not in ("columns", "pack_left", "touching"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.mask_mode not in ("blank", "keep", "reject"):
            raise ValueError(f"unknown mask mode {self.mask_mode!r}")

    @property
    def fields(self) -> list[str]:
        return list(cells.WIDE_FIELDS)

    @property
    def wide(self) -> bool:
        return True

    @property
    def loose(self) -> bool:
        return False

    def matches(self, line: Column) -> Column:
        if self.layout == "pack_left":
            test = cells.is_packed_row(line)
        elif self.layout == "touching":
            test = cells.is_touching_row(line)
        elif self.mask_mode == "reject":
            test = cells.is_numeric_row(line)
        else:
            test = cells.is_column_row(line)
        return F.coalesce(test, F.lit(False))

    def all_present(self, line: Column) -> Column:
        return self.matches(line)

    def prepare(self, header: Column) -> Column:
        return cells.header_places(header)

    def parse(self, line: Column, header: Column | None = None) -> Column:
        if self.layout == "pack_left":
            return cells.packed_row(line)
        if self.layout == "touching":
            return cells.touching_row(line)
        if header is None:
            header = self.prepare(F.lit(None).cast("string"))
        return cells.column_row(line, header)

    def with_parsed(self, rows: DataFrame, line: str, header: str, name: str) -> DataFrame:
        if self.layout != "columns":
            return super().with_parsed(rows, line, header, name)
        return cells.with_column_row(rows, F.col(line), F.col(header), name)

    def values(self, parsed: Column) -> dict[str, Column]:
        out = {}
        for i, name in enumerate(cells.WIDE_FIELDS):
            text = F.get(parsed, F.lit(i))
            if i > 0 and self.mask_mode == "blank":
                text = _mask_off(text)
            out[name] = text
        return out

    def cleaned(self, parsed: Column, line: Column) -> Column:
        def clean(text: Column, i: Column) -> Column:
            if self.mask_mode == "blank":
                return F.when(i > 0, _mask_off(text)).otherwise(text)
            return cells.hash_cleanup(text)

        return F.when(line.contains("#"), F.transform(parsed, clean)).otherwise(parsed)

    def texts(self, cleaned: Column) -> dict[str, Column]:
        return {n: F.get(cleaned, F.lit(i)) for i, n in enumerate(cells.WIDE_FIELDS)}

    def masked(self, parsed: Column) -> Column:
        names = F.array(*[F.lit(c) for c in cells.WIDE_FIELDS])
        flagged = F.transform(parsed, lambda text, i: F.when(text.contains("#"), F.get(names, i)))
        return F.when(F.array_join(parsed, "").contains("#"), F.array_compact(flagged)).otherwise(
            F.array().cast("array<string>")
        )

    def group(self, line: Column, name: str) -> Column:
        return self.values(self.parse(line))[name]


def _after(text: Column, taken: Column | str, more: int = 0) -> Column:
    """What is left of a text after a beginning of the length of ``taken`` and ``more`` characters."""
    length = F.lit(len(taken)) if isinstance(taken, str) else F.char_length(taken)
    return F.substr(text, length + F.lit(more + 1))


def _past(text: Column, label: str) -> Column:
    """What comes after the first ``label``; the text is worked out once, however long its expression."""
    return cells.let(text, lambda t: _after(t, F.substring_index(t, label, 1), len(label)))


def _spaces_off(text: Column) -> Column:
    # without a list of characters Spark takes off spaces alone, and far faster
    return F.trim(text)


@dataclass(frozen=True)
class CutLine(Grammar):
    """A line whose fields are cut out between fixed places; made by ``cut`` from a line.

    ``cut`` gives (is it such a line, the fields); a field is null when it is absent.  ``cut_all`` gives
    the fields of many matching lines at once, from a text of such lines to a text of as many lines.
    """

    pattern: str = ""
    names: tuple[str, ...] = ()
    optional: bool = False
    cut: Callable[[Column], tuple[Column, dict[str, Column]]] = None
    cut_all: Callable[[Column, str], dict[str, Column]] | None = None

    @property
    def fields(self) -> list[str]:
        return list(self.names)

    @property
    def loose(self) -> bool:
        return self.optional

    @property
    def quick(self) -> bool:
        return True

    def matches(self, line: Column) -> Column:
        return self._guarded(line, self.cut(line)[0])

    def all_present(self, line: Column) -> Column:
        test, fields = self.cut(line)
        for value in fields.values() if self.optional else ():
            test = test & value.isNotNull()
        return self._guarded(line, test)

    def group(self, line: Column, name: str) -> Column:
        return self.cut(line)[1].get(name, F.lit(""))

    def parse(self, line: Column, header: Column | None = None) -> Column:
        # inside a lambda the line is worked out once, and the code of a stage stays small
        return F.get(F.transform(F.array(line), super().parse), F.lit(0))

    def parse_entry(self, line: Column) -> Column:
        return super().parse(line)

    def joined(self, lines: Column, name: str, separator: str, absent: str) -> Column:
        if self.cut_all is None:
            return super().joined(lines, name, separator, absent)
        return F.replace(self.cut_all(F.array_join(lines, "\n"), absent)[name], F.lit("\n"), F.lit(separator))


def _label_words(*choices: str) -> Callable[[Column], tuple[Column, dict[str, Column]]]:
    """A marker line: its first words are the label's; the last may go on."""

    labels = "|".join(" ++".join(re.escape(word) for word in choice.split(" ")) for choice in choices)
    return lambda line: (line.rlike(rf"^ *+(?:{labels})"), {})


#: Lines are told by one expression each, which goes on from the first place of every label.
_PLACE_LINE = r"^(?>[\s\S]*?County; )(?>[\s\S]*?Quad; )(?>[\s\S]*? Field ++Pool)"
_BUYER_LINE = r"^ *+Buyer: (?>[\s\S]*?Lease#: )(?>[\s\S]*?Production ++Type )"


def _place(line: Column) -> tuple[Column, dict[str, Column]]:
    """County before its label, then Quad and Pool, each up to its own."""
    rest = _past(line, "County; ")

    def pool(text: Column) -> Column:
        return F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(" Field +Pool")) - 1)

    county, quad = F.substring_index(line, "County; ", 1), F.substring_index(rest, "Quad; ", 1)
    fields = {"County": county, "Quad": quad, "Pool": cells.let(_past(rest, "Quad; "), pool)}
    return line.rlike(_PLACE_LINE), {n: _spaces_off(text) for n, text in fields.items()}


def _buyer(line: Column) -> tuple[Column, dict[str, Column]]:
    """Buyer up to the lease label, Lease up to the type label, Type as one word."""
    # every step is bound by a lambda: written out, the later ones would hold the earlier ones hundreds of times
    body = _after(F.ltrim(line), "Buyer: ")
    rest = _past(body, "Lease#: ")

    def type_at(text: Column) -> Column:
        return F.regexp_instr(text, F.lit("Production +Type "))

    def lease(text: Column) -> Column:
        return F.substring(text, F.lit(1), type_at(text) - 1)

    def kind(text: Column) -> Column:
        unit, word = F.regexp_instr(text, F.lit("Production +Unit")), F.substring_index(text, " ", 1)
        return F.when(unit > 0, F.substring(word, F.lit(1), unit - 1)).otherwise(word)

    kind_on = cells.let(rest, lambda text: F.ltrim(F.substr(text, type_at(text) + len("Production"))))
    # What may stand between the buyer's name and the lease label.
    name = F.regexp_replace(_spaces_off(F.substring_index(body, "Lease#: ", 1)), "Buyer's$", "")
    name = F.regexp_replace(_spaces_off(name), ",$", "")
    fields = {"Buyer": name, "Lease": _spaces_off(cells.let(rest, lease)), "Type": cells.let(F.ltrim(_after(kind_on, "Type ")), kind)}
    return line.rlike(_BUYER_LINE), fields


#: Spaces that stand for an absent permit, and the most characters of one.
NO_PERMIT, LONGEST_PERMIT = 8, 10
_WELL_LINE = rf"^(?! *+Edit)(?:[^ ]{{1,{LONGEST_PERMIT}}}+(?: |\z)| {{{NO_PERMIT}}}\z| {{{NO_PERMIT + 1}}})"


def _well(line: Column) -> tuple[Column, dict[str, Column]]:
    """A permit from the first column on and a name after spaces; either may be absent."""
    # one expression tells the lines: a list has many, and each step on a line costs as much as its text
    indented = line.startswith(" ")
    word = F.substring_index(line, " ", 1)
    permit = F.when(~indented, word)
    name = F.when(indented, F.when(line != " " * NO_PERMIT, F.ltrim(line))).when(
        line.contains(" "), F.ltrim(F.substr(line, F.instr(line, " ")))
    )
    return line.rlike(_WELL_LINE), {"Permit": permit, "Well": name}


def _wells(lines: Column, absent: str) -> dict[str, Column]:
    """The same of a text of such lines; in (?d) nothing but a line feed ends a line."""
    permit = F.regexp_replace(F.regexp_replace(lines, r"(?dm)^ [^\n]*+", absent), r" [^\n]*+", "")
    # a line without a name gets the absent one behind a space, as names are
    named = F.regexp_replace(lines, rf"(?dm)^(?: {{{NO_PERMIT}}}|[^ \n]++)$", f" {absent}")
    return {"Permit": permit, "Well": F.regexp_replace(named, r"(?dm)^[^ \n]*+ *+", "")}


@dataclass(frozen=True)
class Stage:
    """One step of a plan: single-line, or repeating while its grammar matches."""

    name: str
    grammar: Grammar
    repeats: bool = False
    skips: int = 0


@dataclass(frozen=True)
class ReportPlan:
    """Ordered stages plus the output columns.

    ``sticky`` is the index of the repeating stage that never ends (the detail
    table), or ``None``.  ``required`` is the field a document must have read
    before its first repeating line counts.
    """

    stages: tuple[Stage, ...]
    sticky: int | None
    columns: tuple[str, ...]
    required: str = "Quad"
    header_stage: str | None = "Product_by_month_header"

    @property
    def detail(self) -> Stage | None:
        return None if self.sticky is None else self.stages[self.sticky]

    def index_of(self, name: str) -> int | None:
        for i, stage in enumerate(self.stages):
            if stage.name == name:
                return i
        return None

    def with_detail(self, **options) -> "ReportPlan":
        """The same plan with other options on its detail grammar."""
        stages = list(self.stages)
        stages[self.sticky] = replace(
            self.detail, grammar=replace(self.detail.grammar, **options)
        )
        return replace(self, stages=tuple(stages))


# Labels of the monthly production report.
GRAMMARS = {
    "County_Quad_Pool": CutLine(
        "County_Quad_Pool", needs=("County;", "Quad;", "Pool"), names=("County", "Quad", "Pool"), cut=_place
    ),
    "Buyer_Lease_Type_Active": CutLine(
        "Buyer_Lease_Type_Active", needs=("Buyer:", "Lease#:", "Type"), names=("Buyer", "Lease", "Type"), cut=_buyer
    ),
    "Permit_Well_header": CutLine(
        "Permit_Well_header",
        needs=("Permit", "Name"),
        names=(MARKER_FIELD,),
        cut=_label_words("Permit # Well Name", "Permit Well Name"),
    ),
    "Permit_Well": CutLine("Permit_Well", names=("Permit", "Well"), optional=True, cut=_well, cut_all=_wells),
    "Permit_Well_end": CutLine(
        "Permit_Well_end", needs=("Edit",), names=(MARKER_FIELD,), cut=_label_words("Edit Wells", "EditWells")
    ),
    "Product_by_month_header": CutLine(
        "Product_by_month_header",
        needs=("Year", "Totals"),
        names=(MARKER_FIELD,),
        cut=_label_words(" ".join(["Year", *cells.CELLS])),
    ),
    "Product_by_month": WideRow("Product_by_month"),
}

# Stage order (an empty item is one tolerated line), repeating
# stages as from/to pairs, and output columns.
TASKS = [
    "County_Quad_Pool",
    "Buyer_Lease_Type_Active",
    "",
    "Permit_Well_header",
    "Permit_Well",
    "Permit_Well_end",
    "Product_by_month_header",
    "Product_by_month",
]
BRANCHES = ["Permit_Well", "Permit_Well", "Product_by_month", "Product_by_month"]
HEADER = ["Buyer", "Pool", "Permit", "Well", "Quad", "County", "Type", "Lease"]
HEADER += ["<Product_by_month>", "<File>"]


def expand_header(header: list[str], grammars: dict[str, Grammar]) -> list[str]:
    """Replace every ``<Task>`` by that grammar's fields, in group order."""
    out: list[str] = []
    for item in header:
        if not item.startswith("<"):
            out.append(item)
        elif item == f"<{FILE_FIELD}>":
            out.append(FILE_FIELD)
        elif item[1:-1] in grammars:
            out.extend(grammars[item[1:-1]].fields)
        else:
            raise ValueError(f"header item {item} names no grammar")
    return out


def build_plan(
    tasks: list[str],
    branches: list[str],
    header: list[str],
    grammars: dict[str, Grammar],
    required: str = "Quad",
    header_stage: str | None = "Product_by_month_header",
) -> ReportPlan:
    """Resolve task names to stages.

    A from/to pair makes the "from" task repeat, read with the "to" task's
    grammar.  The last pair marks the stage that lasts to the end of document;
    nothing listed after it can become active, so it ends the plan.
    """
    if len(branches) % 2:
        raise ValueError("branch list must hold from/to pairs")
    sources, targets = branches[::2], branches[1::2]
    stages: list[Stage] = []
    sticky, skips = None, 0
    for task in tasks:
        if task == "":
            skips += 1
            continue
        repeats = task in sources
        name = targets[sources.index(task)] if repeats else task
        if name not in grammars:
            raise ValueError(f"no pattern given for task {name!r} of the task list")
        stages.append(Stage(name, grammars[name], repeats, skips))
        skips = 0
        if repeats and sources.index(task) == len(sources) - 1:
            sticky = len(stages) - 1
            break
    columns = tuple(dict.fromkeys(expand_header(header, grammars)))
    return ReportPlan(tuple(stages), sticky, columns, required, header_stage)


def default_plan(layout: str = "columns", mask_mode: str = "blank") -> ReportPlan:
    """The monthly production report."""
    grammars = dict(GRAMMARS)
    grammars["Product_by_month"] = WideRow(
        "Product_by_month", layout=layout, mask_mode=mask_mode
    )
    return build_plan(TASKS, BRANCHES, HEADER, grammars)


@dataclass(frozen=True)
class Settings:
    """Typed settings; names ending in ``_list`` are comma lists, ``b_`` flags."""

    plan: ReportPlan
    options: dict = field(default_factory=dict)


def _as_list(value) -> list[str]:
    items = value.split(",") if isinstance(value, str) else list(value)
    return [item.strip() for item in items]


def typed_options(config: dict) -> dict:
    """Type settings by name: ``*_list`` to list, ``b_*`` to bool, others as they are."""
    out = {}
    for key, value in config.items():
        if key.endswith("_list"):
            out[key[: -len("_list")]] = _as_list(value)
        elif key.startswith("b_"):
            out[key] = value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
        else:
            out[key] = value
    return out


def settings_from_config(config: dict) -> Settings:
    """A plan from user settings, defaults filling what is not given.

    ``re_<Task>`` adds or replaces a grammar.  A key written in lower case is
    accepted for a task of mixed case; a task without any pattern is an error.
    """
    options = typed_options(config)
    tasks = options.pop("tasks", TASKS)
    branches = options.pop("tasks_branch_from_to", BRANCHES)
    header = options.pop("header", HEADER)
    layout = options.pop("layout", "columns")
    mask_mode = options.pop("mask_mode", "blank")
    required = options.pop("required", "Quad")
    grammars = dict(GRAMMARS)
    grammars["Product_by_month"] = WideRow("Product_by_month", layout=layout, mask_mode=mask_mode)
    patterns = {k[3:]: options.pop(k) for k in list(options) if k.startswith("re_")}
    for task in {*tasks, *branches} - {""}:
        given = patterns.pop(task, None) or patterns.pop(task.lower(), None)
        if given is not None:
            grammars[task] = Grammar(task, given)
        elif task not in grammars:
            raise ValueError(f'no "re_" setting given for task {task!r} of tasks_list')
    for name, pattern in patterns.items():
        grammars[name] = Grammar(name, pattern)
    return Settings(build_plan(tasks, branches, header, grammars, required), options)
