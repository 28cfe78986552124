"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankmill.plans import QUERIES  # noqa: E402
from rankmill.session import build_session  # noqa: E402

HEADLINE = (
    "e05_bm25_passages", "l02_bm25", "l12_profile_sweep", "d01_exact_knn", "d05_radial_search", "h01_minmax_fuse",
    "h01_weight_grid", "h04_candidate_rerank", "e05_evaluate", "e15_compare_family", "q01_aggregate_labels",
    "t12_tokenize", "t19_base64_round_trip", "i05_supersede_jobs", "i07_apply_embeddings", "i12_resolved_changes",
    "m01_route_counts", "m03_route_latency", "m15_operations_snapshot", "d09_sparse_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "8m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
