"""Summarise the physical plan of every registered query (shuffles,
broadcasts, joins, windows, Python nodes, scanned columns) into PLANS.md."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tuneweave.plans.catalog import registry  # noqa: E402
from tuneweave.session import get_spark  # noqa: E402

NODES = {
    "shuffles": r"^\(\d+\) Exchange\b",
    "broadcasts": r"^\(\d+\) BroadcastExchange\b",
    "smj": r"^\(\d+\) SortMergeJoin\b",
    "bhj": r"^\(\d+\) BroadcastHashJoin\b",
    "windows": r"^\(\d+\) Window\b",
    "python": r"^\(\d+\) (ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|BatchEvalPython|"
              r"FlatMapGroupsInPandasWithState)",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    rows = []
    for name, (fn, _) in registry().items():
        df = fn(spark, sf)
        text = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        lines = text.splitlines()
        counts = {k: sum(1 for ln in lines if re.search(p, ln)) for k, p in NODES.items()}
        schemas = [ln.split("ReadSchema: ")[1] for ln in lines if "ReadSchema:" in ln]
        cols = sorted({c.split(":")[0] for s in schemas for c in re.findall(r"(\w+):", s)
                       if not c.startswith("struct")} - {"struct", "array", "element"})
        rows.append((name, counts, len(schemas), ", ".join(c for c in cols if not c.startswith("__"))))
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `scripts/plans.py` at {sf} (local[8], 8 shuffle partitions, AQE on; "
           "the adaptive plan before runtime re-planning). Materialised index tables count as "
           "scans. `python` = Arrow-batched Python operators.", "",
           "| query | shuffles | broadcasts | SMJ | BHJ | windows | python | scans | columns read |",
           "| --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, c, nscan, cols in rows:
        out.append(f"| {name} | {c['shuffles']} | {c['broadcasts']} | {c['smj']} | {c['bhj']} | "
                   f"{c['windows']} | {c['python']} | {nscan} | {cols} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"),
              "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
