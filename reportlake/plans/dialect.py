"""Line patterns: accept Python-style expressions, hand Spark a Java one.

Users write grammars with named groups (``(?P<name>...)`` or ``(?<name>...)``),
open-low repeats (``{,9}``) and Unicode classes.  Spark's regex functions run on
the JVM, so the pattern is rewritten once, on the driver, when a plan is built:

* named groups become numbered ones (names are kept on the side, so they may
  hold characters the JVM refuses in a group name);
* ``{,n}`` becomes ``{0,n}``, and a brace that opens no repeat is escaped;
* ``\\d \\w \\s`` become the Unicode classes a Python ``str`` pattern means;
* ``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a line end;
* the whole is anchored at the line start.

``regexp_extract`` yields ``''`` for a group that took no part in the match.
Where that can happen (``optional`` groups) a second expression tells null from
empty: an empty group is placed at the end of the named one and referred to
after an atomic copy of the pattern, so the test holds exactly when the first
match went through the group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_IN_CLASS = {
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{N}_",
    "s": r"\t-\r\x1c-\x1f\x85\p{Z}",
    "b": r"\x08",
}
_BARE = {
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "w": r"[\p{L}\p{N}_]",
    "W": r"[^\p{L}\p{N}_]",
    "s": r"[\t-\r\x1c-\x1f\x85\p{Z}]",
    "S": r"[^\t-\r\x1c-\x1f\x85\p{Z}]",
    "Z": r"\z",
    "b": r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))",
    "B": r"(?:(?<=[\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?![\p{L}\p{N}_]))",
}
_REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_NAMED_REF = re.compile(r"\(\?P=([A-Za-z_]\w*)\)")


@dataclass
class _Group:
    parent: "_Group | None"
    opener: str
    name: str | None = None
    captures: bool = False
    alternates: bool = False
    may_skip: bool = False

    def optional(self) -> bool:
        if self.may_skip:
            return True
        up = self.parent
        while up is not None:
            if up.alternates or up.may_skip:
                return True
            up = up.parent
        return False


@dataclass(frozen=True)
class Pattern:
    """A compiled line pattern: ``java`` for matching, ``groups`` by name."""

    source: str
    java: str
    groups: dict[str, int]
    optional: dict[str, str]
    all_present: str


def _char_class(text: str, i: int) -> tuple[str, int]:
    out, j = ["["], i + 1
    if text[j : j + 1] == "^":
        out.append("^")
        j += 1
    first = True
    while j < len(text):
        ch = text[j]
        if ch == "]" and not first:
            return "".join(out) + "]", j + 1
        first = False
        if ch == "\\":
            nxt = text[j + 1]
            if nxt in "WDS":
                if out[1:2] == ["^"]:
                    raise ValueError(f"negated class inside a negated class: {text!r}")
                out.append(_BARE[nxt])
            else:
                out.append(_IN_CLASS.get(nxt, "\\" + nxt))
            j += 2
            continue
        out.append("\\" + ch if ch in "[]&" else ch)
        j += 1
    raise ValueError(f"unterminated character class in {text!r}")


def _scan(text: str) -> tuple[list, list[_Group]]:
    """Split a pattern into literal pieces and group open/close marks."""
    root = _Group(None, "")
    here, parts, groups, i = root, [], [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            nxt = text[i + 1 : i + 2]
            if nxt.isdigit() and nxt != "0":
                ref = re.match(r"\d{1,2}", text[i + 1 :]).group()
                parts.append(("ref", int(ref)))
                i += 1 + len(ref)
                continue
            parts.append(("text", _BARE.get(nxt, "\\" + nxt)))
            i += 2
        elif ch == "[":
            piece, i = _char_class(text, i)
            parts.append(("text", piece))
        elif ch == "(":
            ref = _NAMED_REF.match(text, i)
            if ref:
                parts.append(("ref", ref.group(1)))
                i = ref.end()
                continue
            named = _NAMED.match(text, i)
            if named:
                new = _Group(here, "(", named.group(1), True)
                i = named.end()
            elif text.startswith("(?", i):
                head = re.match(r"\(\?(?:<[=!]|[=!>]|[a-zA-Z-]*:)", text[i:])
                if head is None:
                    flags = re.match(r"\(\?[a-zA-Z-]+\)", text[i:])
                    if flags is None:
                        raise ValueError(f"unsupported group in {text!r} at {i}")
                    parts.append(("text", flags.group()))
                    i += flags.end()
                    continue
                new = _Group(here, head.group(), may_skip="!" in head.group())
                i += head.end()
            else:
                new = _Group(here, "(", None, True)
                i += 1
            groups.append(new)
            parts.append(("open", new))
            here = new
        elif ch == ")":
            if here is root:
                raise ValueError(f"unbalanced ')' in {text!r}")
            repeat = _REPEAT.match(text, i + 1)
            if text[i + 1 : i + 2] in ("?", "*"):
                here.may_skip = True
            elif repeat and (repeat.group(1) or "0").strip("0") == "":
                here.may_skip = True
            parts.append(("close", here))
            here = here.parent
            i += 1
        elif ch == "{":
            repeat = _REPEAT.match(text, i)
            if repeat and (repeat.group(1) or repeat.group(3)):
                low, comma, high = repeat.groups()
                parts.append(("text", f"{{{low or '0'}{comma}{high}}}"))
                i = repeat.end()
            else:
                parts.append(("text", r"\{"))
                i += 1
        else:
            if ch == "|":
                here.alternates = True
            parts.append(("text", r"\}" if ch == "}" else ch))
            i += 1
    if here is not root:
        raise ValueError(f"unbalanced '(' in {text!r}")
    return parts, groups


def _write(parts: list, marked: frozenset[str] = frozenset()) -> tuple[str, dict, dict]:
    """Render the pieces; ``marked`` names get an empty group at their end."""
    out, count = [], 0
    number: dict[int, int] = {}
    by_order: list[int] = []
    names: dict[str, int] = {}
    marks: dict[str, int] = {}
    for kind, value in parts:
        if kind == "text":
            out.append(value)
        elif kind == "ref":
            index = names[value] if isinstance(value, str) else by_order[value - 1]
            out.append(f"(?:\\{index})")
        elif kind == "open":
            out.append(value.opener)
            if value.captures:
                count += 1
                number[id(value)] = count
                by_order.append(count)
                if value.name:
                    names[value.name] = count
                    if value.name in marked:
                        out.append("(?:")
        else:
            if value.name in marked:
                count += 1
                marks[value.name] = count
                out.append(")()")
            out.append(")")
    return "".join(out), names, marks


def compile_pattern(source: str) -> Pattern:
    """Rewrite a user pattern for the JVM and work out its named groups."""
    parts, groups = _scan(source)
    # ignoring case means all of Unicode, as it does for a Python str
    flags = "(?du)" if re.search(r"\(\?[a-zA-Z]*i", source) else "(?d)"
    plain, names, _ = _write(parts)
    loose = [g.name for g in groups if g.name and g.optional()]
    optional = {}
    for name in loose:
        body, _, marks = _write(parts, frozenset([name]))
        optional[name] = f"{flags}^(?>{body})\\{marks[name]}"
    java = f"{flags}^(?:{plain})"
    all_present = java
    if loose:
        body, _, marks = _write(parts, frozenset(loose))
        tail = "".join(f"(?:\\{marks[n]})" for n in loose)
        all_present = f"{flags}^(?>{body}){tail}"
    return Pattern(source, java, dict(sorted(names.items(), key=lambda kv: kv[1])), optional, all_present)


_QUANTIFIERS = "?*+{"


def fixed_words(source: str) -> list[str]:
    """Texts that every line matching a pattern holds: its literal characters as far as they stand next to each other.

    Only what is certain counts: nothing inside alternatives, look-arounds and groups or characters that may be
    left out, and nothing at all where the pattern sets flags, which may give its characters another meaning.
    """
    parts, _ = _scan(source)
    words, run, closed = [], [], []

    def flush() -> None:
        if run:
            words.append("".join(run))
        run.clear()

    unsure = 0
    for at, (kind, value) in enumerate(parts):
        if kind == "open":
            closed.append(value.alternates or value.may_skip or value.opener not in ("(", "(?:"))
            if "?" in value.opener and value.opener[-1] == ":" and value.opener != "(?:":
                return []
            if closed[-1]:
                flush()
            unsure += closed[-1]
        elif kind == "close":
            after = parts[at + 1][1] if at + 1 < len(parts) and parts[at + 1][0] == "text" else " "
            if closed[-1] or after[0] in _QUANTIFIERS:
                flush()
            unsure -= closed.pop()
        elif kind == "ref":
            flush()
        elif value.startswith("(?") and value not in _BARE.values():
            return []
        elif value == "|" and not closed:
            return []
        elif unsure:
            continue
        elif value[0] in _QUANTIFIERS:
            least = _REPEAT.match(value)
            if run and (value in "?*" or least and int(least[1]) == 0):
                run.pop()
            flush()
        elif len(value) == 1 and value not in ".^$":
            run.append(value)
        elif len(value) == 2 and value[0] == "\\" and not value[1].isalnum():
            run.append(value[1])
        else:
            flush()
    flush()
    return words
