"""Chat formatting by perspective rotation.

Every participant of a conversation is the assistant once: the dialogue is rendered from that
speaker's view, everybody else as a named user, and the mask marks what the speaker said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import stored, table
from reportlake.operators.numbering import numbered, running_total

#: Roles that set the scene: part of every perspective, never its assistant.
CONTEXT = ("system",)
#: Turn numbers of one part, and its rows at most. Parts bound what is gathered for one row, however long a
#: conversation is and however its turns are numbered.
PART_TURNS = 256


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    context: tuple[str, ...] = CONTEXT,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per conversation, speaker and part of ``part_turns`` turn numbers, with columns
    conv_col, speaker, part, n_turns, text and mask (array<struct<start, end>>).

    Each turn is rendered ``<|role|>\\nname: text<|end|>\\n``: the speaker's own turns as assistant
    without a name, context roles as system without a name, all others as user with their name. The
    mask has the half-open code point spans of the own texts, end mark included; spans are kept as
    marks since texts may hold the marks themselves. Parts in order make up the whole dialogue.

    A part of more rows than that (turns without a number, or one number again and again) is cut by
    position, and the parts after it are numbered on, so part is still unique and in order.

    Turns are ordered by number, speaker and text; a null number comes first, in part null (the first
    of them, if there are several; the others come before the lowest number); a null text is empty; rows without a speaker are rendered for the others as user ``unknown`` and get
    no perspective; repeated rows are rendered as often as they occur. A conversation of context
    alone, or with a null id, gives no row. Other columns are not read.
    """
    name = F.col(speaker_col)
    rows = turns.select(
        F.col(conv_col).alias("__conv"),
        F.floor(F.col(turn_col) / part_turns).cast("long").alias("__part"),
        F.col(turn_col).alias("__turn"),
        name.alias("__who"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    ).where("__conv IS NOT NULL")
    scene = F.coalesce(F.col("__who").isin(*context), F.lit(False))
    parts = _parts(rows, part_turns, scene)
    speakers = rows.where(~scene & F.col("__who").isNotNull()).groupBy("__conv", "__who").agg(F.lit(1).alias("__one"))
    met = parts.join(speakers.drop("__one"), "__conv")

    def role(s):
        return F.when(s["scene"], "system").when(F.coalesce(s["who"] == F.col("__who"), F.lit(False)), "assistant").otherwise("user")

    turns_of = F.transform(
        "__said",
        lambda s: F.struct(
            role(s).alias("role"),
            F.concat(
                F.lit("<|"), role(s), F.lit("|>\n"),
                F.when(role(s) == "user", F.concat(F.coalesce(s["who"], F.lit("unknown")), F.lit(": "))).otherwise(F.lit("")),
            ).alias("head"),
            F.concat(s["text"], F.lit("<|end|>")).alias("body"),
        ),
    )
    met = met.withColumn("__turns", turns_of)
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"

    def put(acc, t):
        start = acc["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    mask = F.aggregate(
        "__turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind),
        put,
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("__turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    return met.select(
        F.col("__conv").alias(conv_col),
        F.col("__who").alias("speaker"),
        F.col("__part").alias("part"),
        F.size("__turns").cast("long").alias("n_turns"),
        text.alias("text"),
        mask.alias("mask"),
    )


def _parts(rows: DataFrame, part_turns: int, scene: Column) -> DataFrame:
    """A row per conversation and part, its turns in order. Only rows of overfull parts are numbered."""
    counts = rows.groupBy("__conv", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    full = stored(counts.where(F.col("__rows") > part_turns), "overfull")
    if full.isEmpty():
        return _gathered(rows.withColumn("__piece", F.lit(0).cast("long")), scene).drop("__piece")
    of = full.select(F.col("__conv").alias("__of"), F.col("__part").alias("__in"))
    same = (F.col("__conv") == F.col("__of")) & F.col("__part").eqNullSafe(F.col("__in"))
    rest = rows.join(of, same, "left_anti").withColumn("__piece", F.lit(0).cast("long"))
    cut = numbered(rows.join(of, same, "left_semi"), ["__conv", "__part"], ["__turn", "__who", "__text"], "__n")
    cut = cut.withColumn("__piece", F.floor((F.col("__n") - 1) / part_turns).cast("long")).drop("__n")
    parts = _gathered(rest.unionByName(cut), scene)
    return _numbered_on(parts, counts.join(full.select("__conv").distinct(), "__conv", "left_semi"), part_turns)


def _gathered(rows: DataFrame, scene: Column) -> DataFrame:
    said = F.struct(F.col("__turn").alias("turn"), F.col("__who").alias("who"), F.col("__text").alias("text"), scene.alias("scene"))
    return rows.groupBy("__conv", "__part", "__piece").agg(F.array_sort(F.collect_list(said)).alias("__said"))


def _numbered_on(parts: DataFrame, counts: DataFrame, part_turns: int) -> DataFrame:
    """``parts`` with a part number for every piece: all pieces beyond the first move what follows by one.

    ``counts`` has the rows of every part of the conversations in which a part is overfull.
    """
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__rows") - 1) / part_turns).cast("long")))
    keys = counts.select("__conv", "__part", pieces.alias("__piece"))
    lowest = counts.groupBy(F.col("__conv").alias("__of")).agg(F.coalesce(F.min("__part"), F.lit(0)).alias("__lowest"))
    keys = keys.withColumn("__place", F.struct("__part", "__piece"))
    moved = running_total(keys, ["__conv"], "__place", (F.col("__piece") > 0).cast("long"), "__more")
    moved = moved.where("__more > 0").join(lowest, F.col("__conv") == F.col("__of"))
    moved = moved.select(
        F.col("__conv").alias("__of"), F.col("__part").alias("__in"), F.col("__piece").alias("__at"),
        (F.coalesce(F.col("__part"), F.col("__lowest") - 1) + F.col("__more")).alias("__new"),
    )
    same = (
        (F.col("__conv") == F.col("__of")) & F.col("__part").eqNullSafe(F.col("__in")) & (F.col("__piece") == F.col("__at"))
    )
    met = parts.join(moved, same, "left")
    return met.select("__conv", F.coalesce("__new", "__part").alias("__part"), "__said")


def op2_perspectives(spark, sf_dir):
    found = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return found.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn // 256 AS part, turn, role AS who, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who IS NOT NULL AND who <> 'system'),
r AS (
  SELECT conv_id, speaker, part, text, coalesce(who = speaker, false) AS own,
         row_number() OVER w AS k,
         CASE WHEN who = 'system' THEN '<|system|>' || chr(10)
              WHEN coalesce(who = speaker, false) THEN '<|assistant|>' || chr(10)
              ELSE '<|user|>' || chr(10) || coalesce(who, 'unknown') || ': ' END AS head
  FROM t JOIN speakers USING (conv_id)
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, who, text)),
p AS (SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, part ORDER BY k)::BIGINT AS stop FROM r)
SELECT conv_id, speaker, part, count(*) AS n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg((stop - 8 - length(text))::VARCHAR || '-' || (stop - 1)::VARCHAR, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM p GROUP BY ALL
"""
