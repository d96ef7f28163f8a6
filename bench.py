"""Headline timings: prints one line of JSON.

Each query runs once unmeasured, to compile its code, and twice measured; the mean is given. Every
run builds a new profile, so nothing is taken over from an earlier one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tableprobe import Profile  # noqa: E402
from workload.inputs import STAR, dataset  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tableprobe-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def over(spark, *names):
    return Profile([dataset(spark, FOLDER, n) for n in names])


QUERIES = {
    "column_metrics": lambda s: over(s, "lineitem").metrics,
    "value_freq": lambda s: over(s, "lineitem").value_freq.groupBy("cid").count(),
    "column_profile": lambda s: over(s, "lineitem").column_profile,
    "column_profile_approximate": lambda s: Profile(
        [dataset(s, FOLDER, "lineitem")], approximate=True).column_profile,
    "numeric_stats": lambda s: over(s, "lineitem").numeric_stats,
    "duplicate_rows": lambda s: over(s, "lineitem").duplicates,
    "correlation": lambda s: over(s, "lineitem").correlations(),
    "problems": lambda s: over(s, "lineitem").problems,
    "problems_dirty": lambda s: over(s, "dirty").problems,
    "text_profile": lambda s: over(s, "documents", "pages").column_profile,
    "decision": lambda s: over(s, "lineitem").decision,
    "multi_profile": lambda s: over(s, *STAR).combined_decision,
}


def main() -> None:
    spark = session()
    seconds = {}
    for name, query in QUERIES.items():
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            query(spark).collect()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(sum(taken[1:]) / RUNS, 3)
    spark.stop()
    print(json.dumps({
        "metric": "profiling_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
