"""Times the queries over one set of tables; prints one JSON line.

``BENCH_SF_DIR``  folder of tables (default /root/testdata/sf0.1)
``BENCH_CPUS``    local cores (default 8)
``BENCH_RUNS``    timed runs per query, the best counts (default 2)
``BENCH_QUERIES`` names to run, parted by commas (default all)
"""

from __future__ import annotations

import json
import os
import re
import time

from adtally.plans.registered import QUERIES
from adtally.session import build_session

HEADLINE = "campaign_window_count"


def timed(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    # Every column of every row is computed; nothing is kept or sent to the driver.
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, HEADLINE, folder)  # starts the executor threads and the code cache
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {name: round(min(timed(spark, name, folder) for _ in range(runs)), 4) for name in names}
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "events_per_sec": {
                    name: round(events / seconds[name])
                    for name in (HEADLINE, f"{HEADLINE}_stream", f"{HEADLINE}_json_stream")
                    if name in seconds
                },
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
