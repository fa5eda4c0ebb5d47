"""Time the headline queries; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
Each query is run to completion through the no-op sink (the whole plan
executes, nothing is collected to the driver); the reported time per query
is the median of BENCH_RUNS (default 3) runs after a warm-up on sf0.001.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["grid_ndcg", "grid_topk_hits", "flat_topk", "slerp_fused", "rerank_two_stage",
            "late_interaction", "knn_classification", "hash_encode_documents", "ivf_topk",
            "relevance_counts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vecbench.plans.registry import QUERIES
    from vecbench.session import local_session

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or \
        [n for n in HEADLINE if n in QUERIES]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="vecbench-bench")
    # warm-up on the smallest fixture through the same code paths (JVM codegen,
    # Python workers); reported separately, not part of the total
    t0 = time.perf_counter()
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in names:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "warmup_sec": warmup,
                      "stat": f"median of {runs} runs per query"}))
    spark.stop()


if __name__ == "__main__":
    main()
