"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and fully collected once after one warm-up of the
session; the reported time is wall clock per query (session start excluded).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tabulens.session import get_spark
    from tabulens.plans.registry import all_queries, headline
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = all_queries()
    names = headline()
    # warm-up on the smallest fixture (JVM JIT, codegen caches); not timed
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for n in names:
            qs[n](spark, warm).collect()
    times = {}
    for n in names:
        t0 = time.time()
        rows = qs[n](spark, sf_dir).collect()
        times[n] = round(time.time() - t0, 3)
        assert rows is not None
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
