"""Benchmark the headline queries.

Runs each query over the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints ONE JSON line:

  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is fully computed through Spark's ``noop`` sink (no collect to
the driver). A short warm-up on sf0.01 runs first (untimed) so JVM start-up and
code generation are not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskline.plans.catalog import queries  # noqa: E402
from riskline.session import build_session  # noqa: E402

HEADLINE = [
    "vocabulary", "tfidf", "score_linear", "classification_report", "lr_tfidf_fit",
    "split_stratified", "tfidf_holdout", "scan_report", "frame_sample", "mean_pool",
    "alerts", "stream_score",
]
WARMUP_SF = "/root/testdata/sf0.01"


def _run(spark, fn, sf_dir):
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus))
    q = queries()
    if os.path.isdir(WARMUP_SF):
        for name in ("score_linear", "frame_sample"):
            _run(spark, q[name], WARMUP_SF)
    times = {}
    for name in names:
        times[name] = round(_run(spark, q[name], sf_dir), 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
