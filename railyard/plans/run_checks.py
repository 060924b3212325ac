"""Run registered queries against their oracle:
``python -m railyard.plans.run_checks [names] [--sf DIR]`` (default sf0.01)."""

from __future__ import annotations

import json
import sys
import time

from ..session import build_session
from . import ORACLE, QUERIES
from .check import compare, duck_connection


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    names = [a for a in argv if not a.startswith("--")] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        if name not in ORACLE:
            n = QUERIES[name](spark, sf_dir).count()
            print(json.dumps({"name": name, "rows_only": n, "sec": round(time.time() - t, 2)}))
            continue
        try:
            res = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as exc:  # report and go on
            res = {"name": name, "match": False, "error": str(exc)[:800]}
        res["sec"] = round(time.time() - t, 2)
        bad += not res.get("match")
        print(json.dumps(res, default=str))
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
