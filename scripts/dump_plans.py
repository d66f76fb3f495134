"""Write PLANS.md: physical plans of every table over the written staged tables.

Usage: python scripts/dump_plans.py [sf_dir] [scratch_dir]
The staged tables are built from the driver tables of ``sf_dir`` into
``scratch_dir`` (a new temporary folder by default), then each analytical
table and served query is planned (not run) on them, as the scheduled job
does. A summary counts exchanges and names the aggregate and join operators.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return re.sub(r"#\d+L?", "", re.sub(r", \[plan_id=\d+\]", "", buf.getvalue()))


def summary(txt: str) -> str:
    ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", txt))
    bc = txt.count("BroadcastExchange")
    ops = []
    for op in ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "BroadcastHashJoin",
               "SortMergeJoin", "Window", "WindowGroupLimit", "Expand", "TakeOrderedAndProject", "Generate"):
        n = len(re.findall(r"\b" + op + r"\b", txt))
        if n:
            ops.append(f"{op}×{n}")
    return f"{ex} | {bc} | {', '.join(ops)}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    scratch = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="tenderlake-plans-")
    from tenderlake.operators import explore, marts, quality
    from tenderlake.plans import export, job, serving
    from tenderlake.plans.catalog import Catalog
    from tenderlake.session import build_session
    from tenderlake.sources import bridge, contracts

    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    t = bridge.load_tables(spark, sf_dir)
    bridge.raw_contracts(t).write.mode("overwrite").parquet(f"{scratch}/raw")
    raw = contracts.read_raw(spark, f"{scratch}/raw")
    groups = bridge.groups_reference(t)
    full, marches, tit = job.stage(Catalog(raw, groups), f"{scratch}/staging")
    a1 = marts.ranking_by_group_year(tit)
    a2 = marts.buyer_activity(tit)
    a3 = marts.concentration_by_cpv(tit)
    a4 = marts.spending_by_department(raw)
    a8 = marts.overruns(full)
    items = [
        ("stg_titulaires (join to the reference)", Catalog(raw, groups).stg_titulaires),
        ("A1 ranking_by_group_year", a1), ("A2 buyer_activity", a2), ("A3 concentration_by_cpv", a3),
        ("A4 spending_by_department", a4), ("A5 procedures_by_buyer", marts.procedures_by_buyer(tit)),
        ("A6 anomalies", marts.anomalies(marches)), ("A7 recurring_pairs", marts.recurring_pairs(tit)),
        ("A8 overruns", a8), ("A11 top_unmapped_companies", explore.top_unmapped_companies(raw, groups)),
        ("A14 mapping_coverage", explore.mapping_coverage(tit)),
        ("Q1 ranking", serving.ranking(a1)), ("Q5 search", serving.search(tit, "licence")),
        ("Q6 global_stats", serving.global_stats(tit)), ("Q8 overrun_stats", serving.overrun_stats(a8)),
        ("S2 load_profile", quality.load_profile(raw)), ("S7 contract_sample", export.contract_sample(tit)),
    ]
    out = ["# Physical plans", "",
           f"Generated by `scripts/dump_plans.py` on the staged tables written from `{sf_dir}`",
           "(the scheduled job's shape: marts read the written staged tables). Sizes are test-size,",
           "so small sides show as broadcast; beyond the threshold they become sort-merge joins.",
           "", "| table | shuffles | broadcasts | operators |", "| --- | --- | --- | --- |"]
    plans = []
    for name, df in items:
        txt = plan_text(df)
        out.append(f"| {name} | {summary(txt)} |")
        plans += ["", f"## {name}", "", "```", txt.strip(), "```"]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out + plans) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
