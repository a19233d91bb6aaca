"""Streams that remember something of each key from batch to batch.

What is kept of a key is bounded: its first few events, or that it was seen. The state lives in the
checkpoint, so a stream that is started again goes on where it ended, and it holds whatever the order in
which events arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reportlake.operators.extract import production_wide
from reportlake.operators.worklist import FAILED, FINAL_STATUSES, PENDING
from reportlake.plans.grammar import ReportPlan, default_plan

#: Looks at a folder for one file.
POLLS = 200

Judge = Callable[[list[str], int], tuple[str, int]]


def first_events(events: DataFrame, key: str, order: str, status: str, most: int, judge: Judge) -> DataFrame:
    """``(key, outcome, n)`` of a stream: for each key with new events what ``judge`` says of its first ``most``.

    ``judge`` gets the statuses of the first events by ``order`` (a whole number, one event each) and
    ``most``. A key that has more events in later batches gets another row; the last one holds.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for frame in frames:
            held.update(zip(frame[order].tolist(), frame[status].tolist()))
            held = dict(sorted(held.items())[:most])
        state.update((list(held), list(held.values())))
        outcome, n = judge(list(held.values()), most)
        yield pd.DataFrame({key: [group[0]], "outcome": [outcome], "n": [n]})

    rows = events.select(key, F.col(order).cast("bigint").alias(order), F.col(status).cast("string").alias(status))
    rows = rows.where(F.col(order).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, outcome string, n bigint", "places array<bigint>, statuses array<string>", "update", GroupStateTimeout.NoTimeout
    )


def attempt_outcome(statuses: list[str], most: int) -> tuple[str, int]:
    """The first status that ends the attempts, else failed when none is left; and the attempts it took."""
    for n, status in enumerate(statuses, 1):
        if status in FINAL_STATUSES:
            return status, n
    return (FAILED if len(statuses) >= most else PENDING), len(statuses)


def wait_outcome(statuses: list[str], most: int) -> tuple[str, int]:
    """landed with the first look that found the file ready, gave_up after ``most`` looks, else partial once a part
    of it was there, else started; and the looks it took."""
    if "ready" in statuses:
        return "landed", statuses.index("ready") + 1
    if len(statuses) >= most:
        return "gave_up", len(statuses)
    return ("partial" if "partial" in statuses else "started"), len(statuses)


def keep_latest(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch under its number; one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key of what :func:`keep_latest` wrote."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("outcome", "n"), "batch").alias("last"))
    return last.select(key, "last.*")


def ingest_once(
    docs: DataFrame, out: str, checkpoint: str, landed: str, late: str = "1 day", key: str = "doc_id", plan: ReportPlan | None = None
) -> StreamingQuery:
    """Parses a stream into a parquet table, each document once, however often it lands.

    Keys are remembered for as long as another landing may come (``late`` by the time in ``landed``), so no
    table of what was done is read.
    """
    fresh = docs.withWatermark(landed, late).dropDuplicatesWithinWatermark([key])
    rows = production_wide(fresh, plan or default_plan(), position=True)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
