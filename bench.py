"""Time the headline queries; prints one JSON line.

Reports are rendered once per run (one document per supplier and brand) and
stored, so the report queries time reading and parsing, not rendering; so are
the result pages whose state is told.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from reportlake import catalog
from reportlake.functions.pages import page_state
from reportlake.operators.diagnostics import diagnostics, document_outcomes
from reportlake.operators.extract import production_long, production_wide
from reportlake.plans.grammar import default_plan
from reportlake.session import get_spark, shared_folder
from reportlake.sources.rendered import render_reports, render_result_pages

ROUNDS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def run(name, make, rounds=ROUNDS):
        best = None
        for _ in range(rounds):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)

    folder = f"{shared_folder(spark)}/docs"
    start = time.perf_counter()
    render_reports(spark, sf_dir).write.parquet(folder)
    rendering = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(folder)

    def by_county():
        rows = production_long(docs)
        return rows.groupBy("county", "year").agg({"volume": "sum"})

    run("production_wide", lambda: production_wide(docs))
    run("production_packed", lambda: production_wide(docs, default_plan(layout="pack_left")))
    run("production_by_county", by_county)
    run("diagnostics", lambda: diagnostics(docs))
    run("document_outcomes", lambda: document_outcomes(docs))
    render_result_pages(spark, sf_dir).repartition(int(cpus)).write.parquet(f"{folder}_pages")
    pages = spark.read.parquet(f"{folder}_pages")
    run("page_data_state", lambda: pages.select("c_custkey", page_state(F.col("by_well"), True).alias("well"), page_state(F.col("by_permit"), False).alias("permit")))
    for name in (
        "lines_explode",
        "lines_lookahead",
        "hash_cleanup",
        "page_links_distinct",
        "page_identity",
        "dataset_folder",
        "worklist_remaining",
        "worklist_resume",
        "option_fallback",
        "filename_plan",
        "landing_state",
        "landing_newest",
        "attempt_rollup",
    ):
        run(name, lambda name=name: catalog.QUERIES[name](spark, sf_dir))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rendering_sec": rendering,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
