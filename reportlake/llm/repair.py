"""Repair of conversation structure by a rank-convergent parallel Viterbi search.

The rows of a conversation are cut into chunks. Every chunk works out backward costs from a vector that is
only assumed, but for the last one. Fix-up passes then hand each chunk the vector that the chunk after it
has found, and it is rerun from its end until its vector differs from the one it had there by no more than
a constant; from that row on all that went before still holds. Passes are rerun until no vector changes.
With the costs so stitched together every chunk traces the audit of least cost, and among those the least
by its letters; the traces are joined where they meet.

A vector is kept as its differences from its least entry, so equal ranks are equal values, and each step
on a vector is looked up, worked out only once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import attach, stored, table
from reportlake.operators.numbering import numbered

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a chunk.
CHUNK = 8192
_WHITE = r"\x20\x09-\x0D"
#: What has been said so far: nothing, the scene, up to a user's turn, up to an assistant's.
_EMPTY, _SCENE, _USER, _ASSISTANT = range(4)
#: Where a user's or an assistant's row, kept, changed or put in, leads from each of them.
_TURN = {_EMPTY: (_USER, "u"), _SCENE: (_USER, "u"), _USER: (_ASSISTANT, "a"), _ASSISTANT: (_USER, "u")}
_ROLE = {"u": "user", "a": "assistant"}
#: Backward costs after the last row: of a conversation that is whole, and of one not known to be.
_END = (0, 2 * INSERT, INSERT, 0)
_ASSUMED = (0, 0, 0, 0)


def _code(initial: Column, fault: Column) -> Column:
    """A row as one letter: its initial as it matters here, capital if truncated; x must go."""
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    return F.when(fault.isin("blank", "duplicate"), F.lit("x")).when(fault == "truncated", F.upper(kind)).otherwise(kind)


def _edits(state: int, code: str) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in a state: letter, cost, state after it. No two have the same letter."""
    yield "D", DELETE, state
    if code == "x":
        return
    more = TRUNCATED if code.isupper() else 0
    after, role = _TURN[state]
    if code.lower() == "s" and state == _EMPTY:
        yield "K", KEEP + more, _SCENE
    elif code.lower() == role:
        yield "K", KEEP + more, after
    yield "R", REROLE + more, after


class _Costs:
    """Backward vectors, each as differences from its least entry, and the steps between them."""

    def __init__(self):
        self.steps: dict = {}

    def step(self, vector: tuple, code: str) -> tuple[tuple, int]:
        """The vector before a row and what is added to all its entries."""
        known = self.steps.get((vector, code))
        if known is None:
            here = [min(cost + vector[to] for _, cost, to in _edits(s, code)) for s in range(4)]
            for _ in range(2):  # rows put in before it; more than two would come back to the same state
                here = [min(here[s], INSERT + here[_TURN[s][0]]) for s in range(4)]
            least = min(here)
            known = self.steps[vector, code] = tuple(x - least for x in here), least
        return known

    def back(self, codes: str, vector: tuple) -> tuple:
        for code in reversed(codes):
            vector = self.step(vector, code)[0]
        return vector

    def rerun(self, codes: str, old: tuple, new: tuple) -> tuple | None:
        """The vector before a chunk, run from another one after it; None where both met on the way."""
        for code in reversed(codes):
            if old == new:
                return None
            old, new = self.step(old, code)[0], self.step(new, code)[0]
        return None if old == new else new

    def trace(self, codes: str, vector: tuple, state: int, vectors: list | None = None) -> tuple[str, int]:
        """The least audit of a chunk from a state, and the state after it."""
        vectors = vectors or self.vectors(codes, vector)
        audit = []
        for i, code in enumerate(codes):
            before, after = vectors[i], vectors[i + 1]
            shift = self.step(after, code)[1]
            while True:
                need = before[state] + shift
                ways = [(letter, to) for letter, cost, to in _edits(state, code) if cost + after[to] == need]
                insert = _TURN[state][0]
                if INSERT + before[insert] + shift == need:
                    ways.append(("I", insert))
                letter, state = min(ways)
                audit.append(letter)
                if letter != "I":
                    break
        return "".join(audit), state

    def vectors(self, codes: str, vector: tuple) -> list[tuple]:
        out = [vector]
        for code in reversed(codes):
            out.append(self.step(out[-1], code)[0])
        return out[::-1]

    def constant(self, codes: str, vector: tuple) -> int:
        total = 0
        for code in reversed(codes):
            vector, least = self.step(vector, code)
            total += least
        return total


def _ending(state: int) -> str:
    """What is put in after the last row."""
    return "I" * (_END[state] // INSERT)


def _text(vector: tuple) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def _mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """Rows to rows through a function on dicts, batch by batch."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        costs = _Costs()
        for batch in batches:
            found = [row for x in batch.to_pylist() for row in function(costs, x)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    return rows.mapInArrow(run, schema)


def _stitched(chunks: DataFrame) -> DataFrame:
    """Chunks with ``after``, the backward vector that holds after their last row (null after the very last)."""

    def first(costs, x):
        after = _END if x["last"] else _ASSUMED
        yield x["key"], x["chunk"], _text(after), _text(costs.back(x["codes"], after))

    several = chunks.where("chunk > 0 OR NOT last")
    bounds = stored(_mapped(several.selectExpr("key", "chunk", "codes", "last"), first, "key string, chunk bigint, after string, before string"), "bounds")
    while True:
        ahead = bounds.select("key", (F.col("chunk") - 1).alias("chunk"), F.col("before").alias("found"))
        wrong = stored(bounds.join(ahead, ["key", "chunk"]).where("after <> found"), "wrong")
        if wrong.isEmpty():
            break

        def again(costs, x):
            new = costs.rerun(x["codes"], _vector(x["after"]), _vector(x["found"]))
            yield x["key"], x["chunk"], x["found"], x["before"] if new is None else _text(new)

        met = wrong.join(several.select("key", "chunk", "codes"), ["key", "chunk"])
        mended = _mapped(met, again, "key string, chunk bigint, after string, before string")
        left = bounds.join(wrong.select("key", "chunk"), ["key", "chunk"], "left_anti")
        bounds = stored(left.unionByName(mended), "bounds")
    return chunks.join(bounds.select("key", "chunk", "after"), ["key", "chunk"], "left")


def _traced(chunks: DataFrame) -> DataFrame:
    """Chunks with their audit and cost. A chunk that is not the first is traced from every state, and
    the states in which chunks follow each other choose among the traces."""

    def trace(costs, x):
        after = _vector(x["after"]) if x["after"] else _END
        codes = x["codes"]
        vectors = costs.vectors(codes, after)
        starts = [_EMPTY] if x["chunk"] == 0 else range(4)
        found = [costs.trace(codes, after, s, vectors) for s in starts]
        cost = costs.constant(codes, after) + (vectors[0][_EMPTY] if x["chunk"] == 0 else 0)
        audits = [audit + (_ending(to) if x["last"] else "") for audit, to in found]
        yield x["key"], x["chunk"], audits, [to for _, to in found], cost

    traced = stored(_mapped(_stitched(chunks), trace, "key string, chunk bigint, audits array<string>, ends array<bigint>, cost bigint"), "traced")
    single = traced.where("size(audits) = 1 AND chunk = 0").select(
        "key", "chunk", F.get("audits", F.lit(0)).alias("audit"), "cost", F.lit(_EMPTY).cast("long").alias("start"))
    # one small entry per chunk, of which a conversation has as many as its audit has thousands of letters
    several = traced.where("chunk > 0").select("key").distinct()
    steps = traced.join(several, "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("steps"))

    def follow(costs, x):
        state = _EMPTY
        for step in x["steps"]:
            yield x["key"], step["chunk"], state
            state = step["ends"][0 if step["chunk"] == 0 else state]

    starts = _mapped(steps, follow, "key string, chunk bigint, start bigint").where("chunk > 0")
    later = traced.where("chunk > 0").join(starts, ["key", "chunk"])
    later = later.select("key", "chunk", F.get("audits", F.col("start").cast("int")).alias("audit"), "cost", "start")
    return stored(single.unionByName(later), "audits")


def faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with key, turn, role, pos (from 1, in order) and fault; and with key, pos, role and text; stored.

    Rows are ordered by turn (null first), role and text; a null role or text is one space. The first
    fault counts: blank, duplicate (role and text of an earlier row), truncated (last character that is
    not white space is none of ``.!?``), else null.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    rows = turns.select(
        key.alias("key"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    texts = stored(numbered(rows, ["key"], ["turn", "role", "text"], "pos"), "turns")
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    cut = ~F.col("text").rlike(f"[.!?][{_WHITE}]*\\z")
    rows = texts.select(
        "key", "turn", "role", "pos", blank.alias("blank"), cut.alias("cut"),
        F.unhex(F.sha2(F.concat_ws("\x1f", F.octet_length("role").cast("string"), "role", "text"), 256)).alias("said"),
    )
    # texts stay where they are from here on
    rows = stored(rows, "said")
    again = rows.groupBy("key", "said").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n > 1")
    later = attach(rows.select("key", "said", "pos"), again, ["key", "said"], "n", rows.count()).where("pos > first")
    met = rows.join(later.select("key", "pos", F.lit(True).alias("again")), ["key", "pos"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    return stored(met.select("key", "turn", "role", "pos", fault.alias("fault")), "faults"), texts


def repaired(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their faults, audits, and repaired rows; all by ``key`` (``=`` and the id; empty for a null).

    Faults are those of :func:`faults`. Audits: key, chunk, audit, cost. The edits are Keep (free), Rerole
    to user or assistant (1), Delete (2; the only one for blank and duplicate rows) and Insert of an empty
    user's or assistant's row anywhere (5); a truncated row that stays costs 5. The cheapest edits that give
    role initials ``(s?(ua)+)?`` are found, of equally cheap ones the least by their initials. Repaired rows:
    key, pos, sub (rows put in before a row have lower ones), role, text. Null ids make a conversation,
    repeated rows are duplicates, other columns are not read, and no rows give none.
    """
    rows, texts = faults(turns, conv_col, turn_col, role_col, text_col)
    code = _code(F.substring("role", 1, 1), F.coalesce("fault", F.lit("")))
    number = F.floor((F.col("pos") - 1) / chunk).cast("long")
    chunks = rows.select("key", "pos", number.alias("chunk"), code.alias("code")).groupBy("key", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes")
    )
    last = chunks.groupBy("key").agg(F.max("chunk").alias("most"))
    chunks = stored(chunks.join(last, "key").withColumn("last", F.col("chunk") == F.col("most")).drop("most"), "chunks")
    audits = _traced(chunks)

    def edits(costs, x):
        """A row for every row that stays or is put in, with its place and, if it changes, its role."""
        state, pos, sub, codes = x["start"], x["chunk"] * chunk + 1, 0, x["codes"]
        for letter in x["audit"]:
            code = codes[pos - 1 - x["chunk"] * chunk] if letter != "I" else ""
            if letter != "D":
                scene = letter == "K" and code.lower() == "s"
                to, role = (_SCENE, None) if scene else _TURN[state]
                yield x["key"], pos, sub, letter, _ROLE.get(role)
                state = to
            pos, sub = (pos, sub + 1) if letter == "I" else (pos + 1, 0)

    kept = _mapped(audits.join(chunks.select("key", "chunk", "codes"), ["key", "chunk"]), edits, "key string, pos bigint, sub bigint, edit string, to string")
    kept = stored(kept, "edits")
    stay = kept.where("edit <> 'I'").join(texts.select("key", "pos", "role", "text"), ["key", "pos"])
    stay = stay.select("key", "pos", "sub", F.when(F.col("edit") == "R", F.col("to")).otherwise(F.col("role")).alias("role"), "text")
    new = kept.where("edit = 'I'").select("key", "pos", "sub", F.col("to").alias("role"), F.lit("").alias("text"))
    return rows, audits, stay.unionByName(new)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """key and sha256 of the rows ``role:text`` of a conversation, joined by line breaks; a row at a time."""

    def run(batches):
        key, total = None, None
        for batch in batches:
            out = []
            for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                line = f"{role}:{text}".encode()
                if total is None or name != key:
                    if total is not None:
                        out.append((key, total.hexdigest()))
                    key, total = name, hashlib.sha256(line)
                else:
                    total.update(b"\n" + line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "sha256"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.hexdigest()])], ["key", "sha256"])

    dealt = repaired_rows.repartition("key").sortWithinPartitions("key", "pos", "sub")
    return dealt.select("key", "role", "text").mapInArrow(run, "key string, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations, damaged by a checksum of conv_id and turn."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn"))) % 20
    text = none("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(none("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def _structure(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation: gaps, and the numbers of faults and of neighbours that may not follow each other."""
    count = lambda x: F.count_if(F.col("fault") == x).cast("long").alias(x)
    turns = rows.groupBy("key", "turn").agg(*[count(x) for x in ("blank", "duplicate", "truncated")])
    found = turns.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    # neighbours share one of two ways to cut the rows into pieces of bounded length
    initial = F.substring("role", 1, 1)
    places = rows.select("key", "pos", initial.alias("initial"), F.floor((F.col("pos") - 1) / chunk).alias("part"))
    first = places.where((F.col("pos") - 1) % chunk == 0).where("part > 0").withColumn("part", F.col("part") - 1)
    near = places.unionByName(first)
    before = F.lag("initial").over(Window.partitionBy("key", "part").orderBy("pos"))
    pairs = near.withColumn("before", before).where("before IS NOT NULL")
    illegal = pairs.where(~F.concat("before", "initial").isin("su", "ua", "au")).groupBy("key").agg(F.count(F.lit(1)).alias("illegal"))
    return found.join(illegal, "key", "left").na.fill(0, ["illegal"])


def op13_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    rows, audits, kept = repaired(damaged(given))
    # the audit of a conversation is one value of the result, so its parts meet in one row
    told = audits.groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    every = given.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    met = every.join(_structure(rows), "key", "left").join(told, "key", "left").join(digests(kept), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """The same by a search forward, a row at a time: of each state the least cost and audit, as one text."""

    def add(state: str, cost: str, letter: str) -> str:
        return f"lpad(((left({state}, 12))::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}'"

    insert = f"least(s.c2, {add('s.c0', '5', 'I')}, {add('s.c1', '5', 'I')}, {add('s.c3', '5', 'I')}) AS p2, least(s.c3, {add('s.c2', '5', 'I')}) AS p3"
    none = "repeat('9', 11)"

    def to(target: str, role: str, sources: list[str]) -> str:
        ways = [add(f"p{target}", "2", "D")]
        for x in sources:
            ways.append(f"CASE WHEN NOT gone AND kind = '{role}' THEN {add(f'p{x}', 'late', 'K')} ELSE {none} || '9' END")
            if role != "s":
                ways.append(f"CASE WHEN NOT gone THEN {add(f'p{x}', '1 + late', 'R')} ELSE {none} || '9' END")
        return f"least({', '.join(ways)}) AS c{target}"

    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS damage
  FROM conversations),
d AS (
  SELECT coalesce('=' || conv_id, '') AS key, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM given)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS kind, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM f),
s AS (
  SELECT key, 0::BIGINT AS i, repeat('0', 12) AS c0, repeat('9', 11) || '0' AS c1, repeat('9', 11) || '0' AS c2, repeat('9', 11) || '0' AS c3
  FROM (SELECT DISTINCT key FROM r)
  UNION ALL
  SELECT key, i, {add('p0', '2', 'D')} AS c0, {to('1', 's', ['0'])}, {to('2', 'u', ['0', '1', '3'])}, {to('3', 'a', ['2'])}
  FROM (SELECT r.key, r.i, kind, gone, late, s.c0 AS p0, s.c1 AS p1, {insert}
        FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1)),
best AS (
  SELECT key, i, least(s.c0, s.c3, {add('s.c2', '5', 'I')}) AS way FROM s
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
told AS (SELECT key, left(way, 12)::BIGINT AS cost, substr(way, 13) AS audit FROM best),
letters AS (SELECT key, unnest(generate_series(1, length(audit))) AS p, unnest(string_split(audit, '')) AS letter FROM told WHERE audit <> ''),
placed AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY key ORDER BY p) AS i FROM letters),
stays AS (
  SELECT l.key, p, letter, role, text, row_number() OVER (PARTITION BY l.key ORDER BY p)
           - first_value((letter = 'K' AND kind = 's')::INT) OVER (PARTITION BY l.key ORDER BY p) AS place
  FROM placed l LEFT JOIN r ON r.key = l.key AND r.i = l.i WHERE letter <> 'D'),
lines AS (
  SELECT key, p, CASE letter WHEN 'K' THEN role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                 || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line FROM stays),
hashed AS (SELECT key, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM lines GROUP BY key),
counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY key)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS key FROM conversations)
LEFT JOIN counted USING (key) LEFT JOIN told USING (key) LEFT JOIN hashed USING (key)
"""


ORACLE = _oracle()
