"""Summarise the final (adaptive) physical plans of registered queries.

usage: python tools/plan_summary.py [sf_dir] [name ...]
Prints a markdown table: shuffles, broadcasts, windows, joins, Python nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = [("shuffle", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition"),
         ("reused", r"ReusedExchange"), ("broadcast", r"BroadcastExchange"), ("bhj", r"BroadcastHashJoin"),
         ("smj", r"SortMergeJoin"), ("bnlj", r"BroadcastNestedLoopJoin"), ("window", r"\bWindow \["),
         ("group-limit", r"WindowGroupLimit"), ("python", r"ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas"),
         ("scan", r"FileScan parquet")]


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    os.environ.setdefault("LOGWEAVE_NO_MATERIALIZE", "1")  # show whole plans, not reads of materialized parts
    from logweave.plans import catalog
    from logweave.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | " + " | ".join(k for k, _ in KINDS) + " |")
    print("| --- |" + " --- |" * len(KINDS))
    for name in names or list(catalog.QUERIES):
        catalog.clear_shared()
        df = catalog.QUERIES[name](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("\n+- == Initial Plan ==")[0]
        counts = [len(re.findall(p, final)) for _, p in KINDS]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |", flush=True)


if __name__ == "__main__":
    main()
