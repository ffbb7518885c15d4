"""Summarise the executed (final adaptive) plan of every registered query.

Runs each query once at the given scale (so AQE has re-planned), then counts
shuffles, broadcasts, join and aggregate operators, Python evaluation and
the columns read per Parquet scan. Writes a Markdown table to stdout.
Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, ".")
from tablewarden.plans.queries import QUERIES  # noqa: E402
from tablewarden.session import get_session  # noqa: E402

OPS = ["ShuffleExchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
       "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate",
       "Window", "Generate", "BatchEvalPython", "ArrowEvalPython"]


def summarize(plan) -> dict:
    counts: Counter = Counter()
    scans = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            walk(node.plan())
            return
        if name == "ReusedExchange":
            counts["ReusedExchange"] += 1
        if name == "Exchange" or name.startswith("ShuffleExchange"):
            counts["ShuffleExchange"] += 1
        elif name.startswith("BroadcastExchange"):
            counts["BroadcastExchange"] += 1
        elif name == "InputAdapter" or name.startswith("WholeStageCodegen"):
            pass
        else:
            for op in OPS:
                if name == op or name.startswith(op):
                    counts[op] += 1
        if name.startswith("Scan parquet") or "FileScan" in name:
            meta = node.metadata()
            location = meta.get("Location").getOrElse(None) if meta.contains("Location") else ""
            schema = meta.get("ReadSchema").getOrElse(None) if meta.contains("ReadSchema") else ""
            pushed = meta.get("PushedFilters").getOrElse(None) if meta.contains("PushedFilters") else "[]"
            table = re.search(r"/([a-z_]+)\.parquet", str(location))
            ncols = str(schema).count(":") if schema else 0
            scans.append(f"{table.group(1) if table else '?'}({ncols} cols"
                         + (", pushed" if pushed and str(pushed) != "[]" else "") + ")")
        it = node.children().iterator()
        while it.hasNext():
            walk(it.next())
        sub = node.subqueries().iterator()
        while sub.hasNext():
            walk(sub.next())

    walk(plan)
    return {"counts": counts, "scans": sorted(set(scans))}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    print(f"# Final plans at {sf_dir.rsplit('/', 1)[-1]}\n")
    print("Generated by `python tools/plan_report.py`: each query runs once (noop sink) and the final adaptive "
          "plan is summarised. `shuffle` = shuffle exchanges, `bcast` = broadcast exchanges, `BHJ`/`SMJ`/`BNLJ` = "
          "broadcast-hash / sort-merge / broadcast-nested-loop joins, `agg` = hash/object-hash/sort aggregates, "
          "scans list the columns read per table (`pushed` = filters pushed into the Parquet reader).\n")
    print("| query | shuffle | bcast | BHJ | SMJ | BNLJ | agg (hash/obj/sort) | window | python | scans |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarize(df._jdf.queryExecution().executedPlan())
        c = s["counts"]
        py = c["BatchEvalPython"] + c["ArrowEvalPython"]
        print(f"| `{name}` | {c['ShuffleExchange']} | {c['BroadcastExchange']} | {c['BroadcastHashJoin']} | "
              f"{c['SortMergeJoin']} | {c['BroadcastNestedLoopJoin'] + c['CartesianProduct']} | "
              f"{c['HashAggregate']}/{c['ObjectHashAggregate']}/{c['SortAggregate']} | {c['Window']} | {py} | "
              f"{', '.join(s['scans'])} |")
    spark.stop()


if __name__ == "__main__":
    main()
