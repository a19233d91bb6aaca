from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from reportlake.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every edit of every row with every insertion, tried one after the other."""
    marks = fault_of(rows)
    best = None
    ways = []
    for (role, text), mark in zip(rows, marks):
        late = 5 * (mark == "truncated")
        own = [("D", 2, [])]
        if mark not in ("blank", "duplicate"):
            own += [("K", late, [(role, text)])] + [("R", 1 + late, [(r, text)]) for r in ("user", "assistant")]
        ways.append(own)
    fills = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    for edits in itertools.product(*ways):
        if sum(e[1] for e in edits) > 2 * len(rows):
            continue  # deleting everything is cheaper
        for fill in itertools.product(fills, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, fill))
            if cost > 2 * len(rows) or (best and cost > best[0]):
                continue
            out, audit = [], ""
            for f, edit in zip(fill, [*edits, None]):
                out += [(r, "") for r in f]
                audit += "I" * len(f)
                if edit:
                    out += edit[2]
                    audit += edit[0]
            if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def ordered(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append(((turn is not None, turn or 0), (" " if role is None else role).encode(), (" " if text is None else text).encode()))
    return {c: [(r.decode(), t.decode()) for _, r, t in sorted(x)] for c, x in out.items()}


def result(spark, turns, **options):
    rows, audits, kept = repair.repaired(turns, **options)
    told = defaultdict(lambda: [0, "", []])
    for r in audits.orderBy("chunk").collect():
        told[r["key"]][0] += r["cost"]
        told[r["key"]][1] += r["audit"]
    for r in kept.orderBy("pos", "sub").collect():
        told[r["key"]][2].append((r["role"], r["text"]))
    sums = {r["key"]: r["sha256"] for r in repair.digests(kept).collect()}
    marks = defaultdict(list)
    for r in rows.orderBy("pos").collect():
        marks[r["key"]].append(r["fault"] or "")
    for key, (_, _, lines) in told.items():
        if lines:
            assert sums[key] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
    return told, marks


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Hm! \n", "", " ", None, f"t{rng.random()}.", f"open {rng.random()}", "a."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 8192])
def test_equals_every_edit_tried(spark, chunk):
    rows = conversations(random.Random(chunk), 60, 4) + [(None, 1, "assistant", "x."), (None, 2, "user", "y.")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS pos", "'k' AS key", "'c' AS chunk")
    told, marks = result(spark, turns, chunk=chunk)
    for conv, lines in ordered(rows).items():
        key = "" if conv is None else f"={conv}"
        assert marks[key] == fault_of(lines)
        cost, audit, out = cheapest(lines)
        assert tuple(told[key][:2]) == (cost, audit) and told[key][2] == out


def test_chunks_do_not_matter(spark):
    """Long conversations, with runs that make speculation fail, cut into chunks of any length."""
    rng = random.Random(9)
    rows = conversations(rng, 4, 300)
    rows += [(7, i, "user", f"open {i}") for i in range(100)] + [(7, 100 + i, "assistant", "same.") for i in range(100)]
    rows += [(8, i, "user", f"open {i:03}") for i in range(120)] + [(8, 500, "user", "x."), (8, 501, "assistant", "y.")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole, _ = result(spark, turns)
    for chunk in (3, 32):
        assert result(spark, turns, chunk=chunk)[0] == whole


def test_fix_up_ends_where_vectors_meet():
    costs = repair._Costs()
    codes = "sua" + "ua" * 50 + "xUo"
    one, other = costs.back(codes, repair._END), costs.rerun(codes, repair._ASSUMED, repair._END)
    assert (costs.back(codes, repair._ASSUMED) == one) == (other is None)
    assert len(costs.steps) < 60


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    rows, audits, kept = repair.repaired(none)
    assert (rows.count(), audits.count(), kept.count(), repair.digests(kept).count()) == (0, 0, 0, 0)


def test_damage(spark):
    import zlib

    rows = [(c, t, r, "Hi. Yes!") for c in (1, None) for t in [*range(60), None] for r in ("user", None)]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, said in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        want = ("user" if kind == 4 else text(role), {1: "", 2: "Hi Yes"}.get(kind, said))
        assert got[conv, turn].count(want) == {0: 0, 3: 2}.get(kind, 1) * (2 if kind == 4 else 1)
