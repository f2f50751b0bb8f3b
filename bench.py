"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores),
BENCH_QUERIES (comma-separated names) and BENCH_VERBOSE=1 adjust a run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from registry import load  # noqa: E402

HEADLINE = [
    "a0_rate_by_quartile", "a2_quantile7", "a2_quantile7_grouped", "a3_quantile3", "a5_baseline_table",
    "a5e_kruskal_wallis", "f2_iqr_fence", "f4_missing_profile", "f6_impute_pmm", "v1_kaplan_meier",
    "v1_kaplan_meier_many_times", "v4_logrank", "v5_cox_fit", "v5_cox_fit_many_times", "v9_univariable_sweep",
    "v14_adjusted_model2", "v15_adjusted_model3", "v17_cox_spline", "v20_subgroup_cox", "t2_coarse_scan",
    "t4_narrowing", "t5_exhaustive_search", "t7_two_piece_cox", "t8_two_piece_logistic", "t9_two_piece_linear",
    "g1_logistic_fit", "g2_linear_fit", "g4_auc_single", "g7_score_comparison",
]


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("riskset-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)))
    queries, _ = load()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries["g2_linear_fit"](spark, sf_dir).collect()  # start the JVM's and the workers' code paths
    spark.catalog.clearCache()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
