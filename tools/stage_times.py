"""Longest stages from a Spark event log (JSON lines).

usage: python tools/stage_times.py <event log file> [top]
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of a single event log file or of a rolling log directory."""
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        if f.endswith(".zstd"):  # Spark 4 compresses event logs with zstd by default
            import io

            import zstandard

            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f, encoding="utf-8") as fh:
                yield from fh


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    job_of: dict[int, int] = {}
    jobs: dict[int, str] = {}
    job_start: dict[int, int] = {}
    job_time: dict[int, float] = {}
    if True:
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                props = ev.get("Properties") or {}
                jobs[ev["Job ID"]] = (props.get("spark.job.description") or props.get("callSite.short") or "")[:60]
                job_start[ev["Job ID"]] = ev.get("Submission Time", 0)
            elif kind == "SparkListenerJobEnd":
                job_time[ev["Job ID"]] = (ev.get("Completion Time", 0) - job_start.get(ev["Job ID"], 0)) / 1000.0
                for sid in ev.get("Stage IDs", []):
                    job_of[sid] = ev["Job ID"]
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000.0
                stages.append((dur, info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:70]))
    total = defaultdict(float)
    for dur, sid, _, _ in stages:
        total[job_of.get(sid, -1)] += dur
    print(f"{len(stages)} stages, {sum(d for d, *_ in stages):.1f}s stage time")
    for dur, sid, ntasks, name in sorted(stages, reverse=True)[:top]:
        print(f"{dur:7.2f}s  stage {sid:4d}  tasks {ntasks:5d}  job {job_of.get(sid, -1):4d}  {name}")
    print("jobs by wall time:")
    for jid, dur in sorted(job_time.items(), key=lambda t: -t[1])[:top]:
        print(f"{dur:7.2f}s  job {jid:4d}  {jobs.get(jid, '')}")


if __name__ == "__main__":
    main()
