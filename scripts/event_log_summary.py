"""Summarise a Spark event log: slowest stages with task count and skew.

Usage: python scripts/event_log_summary.py <event log dir or file> [top_n]
Run a job with spark.eventLog.enabled=true and spark.eventLog.dir=<scratch>
first. For each stage: wall time, tasks, longest and median task, and their
ratio (a high ratio points at a skewed partition).
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    with open(path, "rb") as fh:
        data = fh.read()
    if path.endswith(".zstd"):
        import zstandard
        data = zstandard.ZstdDecompressor().stream_reader(data).read()
    return data.decode("utf-8").splitlines()


def main():
    target = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    files = [target] if os.path.isfile(target) else sorted(
        f for f in glob.glob(os.path.join(target, "**", "*"), recursive=True)
        if os.path.isfile(f) and os.path.basename(f).startswith(("events_", "eventlog", "local-", "app-")))
    stages, tasks = {}, defaultdict(list)
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:48], si["Number of Tasks"],
                                          (si.get("Completion Time") or 0) - (si.get("Submission Time") or 0))
            elif kind == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks[e["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
    rows = []
    for sid, (name, n, wall) in stages.items():
        t = tasks.get(sid) or [0]
        med = statistics.median(t)
        rows.append((wall, sid, name, n, max(t), med, (max(t) / med) if med else 0.0))
    rows.sort(reverse=True)
    print(f"{'wall_ms':>8} {'stage':>5} {'tasks':>5} {'max_ms':>7} {'med_ms':>7} {'skew':>6}  name")
    for wall, sid, name, n, mx, med, ratio in rows[:top]:
        print(f"{wall:8d} {sid:5d} {n:5d} {mx:7d} {med:7.0f} {ratio:6.1f}  {name}")
    print(f"stages={len(rows)} total_wall_ms={sum(r[0] for r in rows)} task_ms={sum(sum(v) for v in tasks.values())}")


if __name__ == "__main__":
    main()
