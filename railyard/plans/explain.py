"""Print the formatted physical plan of registered queries:
``python -m railyard.plans.explain <name> [<name> ...] [--sf DIR]``."""

from __future__ import annotations

import sys

from ..session import build_session
from . import QUERIES


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    for name in argv or sorted(QUERIES):
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
