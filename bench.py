"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from riskspark.core.session import local_session  # noqa: E402
from riskspark.operators import consensus as G  # noqa: E402
from riskspark.operators import resample as B  # noqa: E402
from riskspark.operators import splits as P  # noqa: E402
from riskspark.operators import thresholds as T  # noqa: E402
from riskspark.plans import QUERIES  # noqa: E402
from riskspark.plans.inference_queries import rankings  # noqa: E402
from riskspark.plans.tables import scored, scored_lines, table  # noqa: E402


def bundle(spark, sf):
    return T.threshold_bundle(scored_lines(spark, sf), ["model", "split_seed"], 0.95, 0.3)


def bootstrap_200(spark, sf):
    return B.bootstrap_ci(scored(spark, sf), ["model"], "id", ("auroc", "prauc"), 200)


def splits_30(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.monotonically_increasing_id().alias("id"), F.col("l_returnflag").alias("stratum"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return P.split_summary(P.repeated_splits(rows, 0.2, 0.2, 30, 0, y="y"))


def consensus_permutations(spark, sf):
    return G.rra_permutation(rankings(spark, sf), 100)


BENCH = {
    "discrimination_docs": QUERIES["discrimination"],
    "discrimination_600k": QUERIES["discrimination_lines"],
    "auroc_20_keys": QUERIES["auroc"],
    "threshold_bundle_20_keys": bundle,
    "decision_curve": QUERIES["decision_curve_lines"],
    "calibration_bins": QUERIES["calibration_bins"],
    "brier_decomposition": QUERIES["brier_decomposition"],
    "roc_band": QUERIES["roc_band"],
    "bootstrap_200": bootstrap_200,
    "splits_30_seeds": splits_30,
    "mann_whitney_70_features": QUERIES["mann_whitney_screen"],
    "wald_70_features": QUERIES["wald_screen"],
    "spearman_64_features": QUERIES["correlation_pairs_spearman"],
    "correlation_components": QUERIES["components"],
    "importance_over_folds": QUERIES["importance_over_folds"],
    "rank_aggregate": QUERIES["rank_aggregate_geometric_mean"],
    "consensus_100_permutations": consensus_permutations,
    "bh_adjust": QUERIES["bh_adjust"],
    "size_three_criterion": QUERIES["size_three_criterion"],
    "pooled_null": QUERIES["pooled_null"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    table(spark, sf, "lineitem").agg(F.count(F.lit(1))).collect()
    times = {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        t = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
