"""Summarise stage times from a Spark event log folder (dev tool, not a test).

    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tests/eventlog_stages.py <that folder>/eventlog_v2_*
"""

from __future__ import annotations

import io
import json
import os
import sys


def stages(folder: str):
    import zstandard
    for name in sorted(os.listdir(folder)):
        if not name.startswith("events_"):
            continue
        raw = open(os.path.join(folder, name), "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if name.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            event = json.loads(line)
            if event.get("Event") == "SparkListenerStageCompleted":
                info = event["Stage Info"]
                seconds = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
                yield seconds, info.get("Number of Tasks", 0), info["Stage Name"]


def main(folder: str) -> None:
    rows = list(stages(folder))
    print(f"stages {len(rows)}  tasks {sum(r[1] for r in rows)}  "
          f"summed stage seconds {sum(r[0] for r in rows):.1f}")
    for seconds, tasks, name in sorted(rows, reverse=True)[:10]:
        print(f"{seconds:7.2f}s {tasks:5d} tasks  {name[:80]}")


if __name__ == "__main__":
    main(sys.argv[1])
