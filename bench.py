"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once cold and ``BENCH_REPEATS`` times warm; ``queries`` holds the
best warm seconds, ``cold`` the first run. Results are produced in full and
thrown away.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from rowtide.plans import catalog  # noqa: E402
from rowtide.session import local_session  # noqa: E402

HEADLINE = [
    "decode_events",
    "rejects_by_reason",
    "infer_schema_batch",
    "missing_columns",
    "type_conflicts",
    "replay_upsert",
    "replay_upsert_map",
    "replay_ignore",
    "replay_replace_violations",
    "replay_incremental",
    "batch_outcome",
    "dedup_events",
    "failure_streaks",
    "throughput_minute",
    "missing_refs",
    "with_type",
    "stream_fan_out",
    "stream_replay",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    frame = catalog.QUERIES[name](spark, sf_dir)
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        runs = [run(spark, name, sf_dir) for _ in range(1 if name.startswith("stream_") else repeats)]
        warm[name] = round(min(runs), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": float(sf),
            }
        )
    )


if __name__ == "__main__":
    main()
