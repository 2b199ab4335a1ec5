"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Every
query runs in full, its rows go to Spark's noop sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from solvetrail.queries import registered
from solvetrail.session import local_session

HEADLINES = (
    "o3_limited",
    "j2_calendar",
    "e1_solved",
    "e1_solved_lines",
    "a1_topics",
    "a1_topics_mapped",
    "a1_topics_lines",
    "e3_daily_progress_lines",
    "w4a_streaks_lines",
    "a5_best_weekday",
    "a7_complexity_trend_lines",
    "a8_summary_lines",
    "a9_user_stats",
    "x3_changes",
    "x7_completion",
    "e8_full_refresh",
    "e9_incremental",
    "e11_e12_backup_restore",
    "t1_stream_ingest",
)
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "16g")
    spark.conf.set("spark.sql.shuffle.partitions", cores)
    queries = registered()
    queries["a1_topics"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
