"""Bench: run every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full plan, no
driver collection). Prints one JSON line with per-query seconds and the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from railyard.plans import QUERIES  # noqa: E402
from railyard.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = build_session(
        f"local[{cpus}]",
        app_name="railyard-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus * 2)),
        extra={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "64m"},
    )
    names = only or sorted(QUERIES)
    # warm-up: JVM, codegen caches and file listing, not counted; one query of each family
    first = {}
    for name in sorted(QUERIES):
        first.setdefault(QUERIES[name].__module__, name)
    for name in (["global_totals"] if only else sorted(first.values())):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
