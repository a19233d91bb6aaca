"""Streams with bounded state per key, started anew between batches."""

from __future__ import annotations

import pytest

from reportlake.streaming import state


@pytest.mark.parametrize(
    "statuses, attempts, waits",
    [
        ([], ("pending", 0), ("started", 0)),
        (["retry", "ok", "no_data"], ("ok", 2), ("gave_up", 3)),
        (["retry", "partial", "retry"], ("failed", 3), ("gave_up", 3)),
        (["retry", "partial"], ("pending", 2), ("partial", 2)),
        (["partial", "not_ready", "ready"], ("failed", 3), ("landed", 3)),
    ],
)
def test_outcomes(statuses, attempts, waits):
    assert state.attempt_outcome(statuses, 3) == attempts
    assert state.wait_outcome(statuses, 3) == waits


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    """Events in any order, twice, of null keys and without a place; a run without news changes nothing."""
    log = spark.createDataFrame(
        [("a", 3, "ok"), ("a", 1, "retry"), ("b", 9, "no_data"), (None, 1, "ok"), ("a", 2, "retry"), ("b", 2, "retry"), ("c", None, "ok"),
         ("b", 1, "retry"), ("b", 3, "retry"), ("a", 1, "retry")],
        "k string, n bigint, s string",
    )
    seen = []
    for low, high in ((0, 4), (4, 10), (10, 10)):
        rows = spark.createDataFrame(log.collect()[low:high], log.schema)
        rows.repartition(2).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
        found = state.first_events(stream, "k", "n", "s", 3, state.attempt_outcome)
        state.keep_latest(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        rows = state.latest(spark.read.parquet(str(tmp_path / "out")), "k").collect()
        seen.append({r["k"]: (r["outcome"], r["n"]) for r in rows})
    assert seen[0] == {"a": ("ok", 2), "b": ("no_data", 1), None: ("ok", 1)}
    assert seen[1] == seen[2] == {"a": ("ok", 3), "b": ("failed", 3), None: ("ok", 1)}
