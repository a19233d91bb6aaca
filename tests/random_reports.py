"""Reports with every kind of damage, from a seed."""

from __future__ import annotations

import random

HEADER = "  Year" + "".join(f" {m:>8}" for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Totals".split())


def row(rng: random.Random) -> str:
    year = rng.choice(["2011", "2012", "98", "Totals", "1999"])
    cells = []
    for _ in range(13):
        kind = rng.random()
        if kind < 0.85:
            cells.append(str(rng.randint(0, 99999)))
        elif kind < 0.9:
            cells.append(f"{rng.randint(0, 999)}.{rng.randint(0, 99)}")
        elif kind < 0.94:
            cells.append("#" * rng.randint(1, 12))
        elif kind < 0.97:
            cells.append("")
        elif kind < 0.985:
            cells.append(f"{rng.randint(0, 99)}#{rng.randint(0, 9)}")
        else:
            cells.append(f"{rng.randint(0, 99)}##")
    gap = rng.choice([1, 2, 3, 9])
    text = rng.choice(["", "  ", "~ "]) + year
    for c in cells:
        text += " " * max(gap, 1) + c if rng.random() < 0.5 else " " + c.rjust(8)
    return text + " " * rng.choice([0, 0, 0, 1, 5, 12, 30]) + rng.choice(["", "", "", "#", "x"])


def odd_row(rng: random.Random) -> str:
    """A year followed by anything made of cell characters."""
    pieces = ["1", "23", "4.5", "123456789", "1234567890", "#", "##", "#" * 9, "#" * 10, " ", "  ", " " * 9, " " * 17, " " * 27]
    return "2012" + "".join(rng.choice(pieces) for _ in range(rng.randint(5, 34)))


def name(rng: random.Random, most: int = 3) -> str:
    """Made-up words, some with the marks that names have."""
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(1, 8))).title() for _ in range(rng.randint(1, most))]
    return " ".join(w + rng.choice(["", "", "", ",", ".", "-2", " & Co"]) for w in words)


def wide(rng: random.Random, most: int = 6) -> str:
    return " " * rng.randint(1, most)


def place(rng: random.Random) -> str:
    parts = [rng.choice(["", name(rng, 2)]) for _ in range(3)]
    line = wide(rng, 3)[1:]
    for part, label in zip(parts, ("County;", "Quad;", "Field")):
        line += part + wide(rng, 2) + label + " "
    return line + wide(rng, 2)[1:] + "Pool" + rng.choice(["", "", " " + name(rng, 1)])


def buyer(rng: random.Random) -> str:
    who = name(rng) + rng.choice(["", "", ",", "  Buyer's", " Buyer's"])
    lease = rng.choice(["", str(rng.randint(1, 99999)), name(rng, 1)])
    kind = rng.choice(["Gas", "Oil", name(rng, 1).split(" ")[0]])
    end = rng.choice(["", wide(rng) + "Production" + wide(rng) + "Unit", " " + name(rng, 1)])
    return f"{wide(rng, 2)[1:]}Buyer:{wide(rng)}{who}{wide(rng)}Lease#:{wide(rng)}{lease}{wide(rng)}Production{wide(rng)}Type{wide(rng)}{kind}{end}"


def listed(rng: random.Random) -> str:
    permit = "".join(rng.choice("0123456789K") for _ in range(rng.randint(5, 11)))
    shapes = [permit + wide(rng, 9) + name(rng), " " * rng.randint(1, 14) + name(rng), permit, permit + " ", " " * rng.randint(7, 10)]
    return rng.choices(shapes, [6, 3, 1, 1, 1])[0]


def report(rng: random.Random) -> str:
    marker = ["Permit", *rng.choice([["#"], []]), "Well", "Name"]
    lines = [place(rng), buyer(rng), name(rng), wide(rng)[1:] + "".join(w + wide(rng) for w in marker).rstrip()]
    lines += [listed(rng) for _ in range(rng.randint(0, 4))]
    lines += ["   Edit   Wells", HEADER]
    for _ in range(rng.randint(0, 6)):
        lines.append(odd_row(rng) if rng.random() < 0.15 else row(rng))
    lines.append("Page 1 of 1")
    damage = rng.random()
    out = []
    for line in lines:
        if damage < 0.6:
            kind = rng.random()
            if kind < 0.05:
                continue
            if kind < 0.12:
                out.append(rng.choice(["junk", "~~ x ~~", "   ", line, "Edit Wells", row(rng)]))
            if kind < 0.16:
                out.append("junk 2")
            if 0.16 < kind < 0.22:
                out.append(rng.choice(["Page 1", row(rng)]))
                line = "\f" + line
            if 0.22 < kind < 0.24:
                line = "\f"
            if 0.24 < kind < 0.27:
                out.append("")
        out.append(line)
    if rng.random() < 0.1:
        rng.shuffle(out)
    end = rng.choice(["\n", "\n", "\r\n", "\n\r"])
    return ("\f" if rng.random() < 0.08 else "") + end.join(out) + rng.choice(["", "\n", "\r\n"])
