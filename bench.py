"""Warm median seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query.
Each run builds the plan anew and aggregates every column of the result, so that all of it is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from gradewell.plans.registry import load_catalog
from gradewell.session import build_session

HEADLINE = [
    "h03_summary_metrics", "h08_roc_auc", "h09_macro_auc", "h12_threshold_sweep", "h13_operating_points", "h14_metrics_per_source",
    "g01_split_80_20", "g03_stratified_folds", "d01_content_duplicates", "d03_vector_duplicates", "c01_resolve_files",
    "c09_near_duplicate_pairs", "e04_column_quality", "e05_variance_audit", "e13_fisher_scores", "b08_burden_features",
    "b13_quality_gate", "b18_screening_result", "b20_probability_features", "s01_session_summary", "s05_gap_sessions", "s06_feedback_sliding",
]


def run(df) -> None:
    df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog().queries
    seconds = {}
    for name in names:
        run(catalog[name](spark, folder))
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(catalog[name](spark, folder))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of warm median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
