"""Print the final (post-AQE) physical plan tree of registered queries.

    python tools/show_plans.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    from tessera.queries import Q
    from tessera.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    for name in args.names:
        df = Q[name](spark, args.sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {name}\n\n```")
        for line in plan.splitlines():
            line = line.split(", Statistics(")[0]
            print(line[:160])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
