"""Print per-stage wall time and task count from a Spark event log folder
(written with SITELENS_EVENT_LOG=file:///some/scratch/folder)."""

import json
import os
import sys


def main(folder: str) -> None:
    for root, _, files in os.walk(folder):
        for name in sorted(files):
            if not name.startswith("events") and not name.startswith("local-"):
                continue
            stages = {}
            with open(os.path.join(root, name), encoding="utf-8") as fh:
                for line in fh:
                    e = json.loads(line)
                    if e.get("Event") == "SparkListenerStageCompleted":
                        si = e["Stage Info"]
                        dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                        stages[si["Stage ID"]] = (round(dur, 2), si["Number of Tasks"], si["Stage Name"][:70])
            for k in sorted(stages):
                print(k, *stages[k])


if __name__ == "__main__":
    main(sys.argv[1])
