"""Audit the physical plans of every registered query.

usage: python tools/plan_audit.py [sf_dir] [name-substring ...]
Reports per query: shuffle exchanges, broadcast exchanges, sort-merge / hash
joins, and flags cartesian products, nested-loop joins, Python UDF nodes,
single-partition exchanges.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillpoint.plans import catalog  # noqa: E402
from tillpoint.session import get_session  # noqa: E402

FLAGS = {
    "CartesianProduct": "cartesian",
    "BroadcastNestedLoopJoin": "nested-loop",
    "BatchEvalPython": "python-udf",
    "ArrowEvalPython": "pandas-udf",
    "SinglePartition": "single-partition",
}


def audit(plan: str) -> dict:
    out = {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "flags": sorted({v for k, v in FLAGS.items() if k in plan}),
    }
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in catalog.queries().items():
        if pats and not any(p in name for p in pats):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        a = audit(plan)
        print(f"{name:34s} shuffles={a['shuffles']:3d} bcast={a['broadcasts']:2d} smj={a['smj']:2d} "
              f"bhj={a['bhj']:2d} {' '.join(a['flags'])}")
    spark.stop()


if __name__ == "__main__":
    main()
