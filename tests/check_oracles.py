"""Run registered queries against their SQL in DuckDB: ``python tests/check_oracles.py [sf] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(
            tuple(
                "\0null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else
                repr(float(v)) if isinstance(v, float) else str(v)
                for v in row
            )
        )
    return sorted(rows)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when both results hold the same columns and rows."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    a, b = _plain(spark_rows), _plain(sql_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(sf: str, names: list[str]) -> None:
    from reportlake.session import get_spark

    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            built = time.time() - start
            rows = frame.toPandas()
            took = time.time() - start
            if name in oracles:
                expected = con.execute(oracles[name]).df()
                verdict = differences(rows, expected) or "ok"
                types = {c: (str(rows[c].dtype), str(expected[c].dtype)) for c in rows.columns
                         if c in expected and rows[c].dtype != expected[c].dtype}
                verdict += f" {types}" if types else ""
            else:
                verdict = "rows only"
            print(f"{name:28s} {len(rows):8d} {built:6.1f} {took:6.1f}s {verdict[:600]}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} FAILED {str(error)[:900]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:])
