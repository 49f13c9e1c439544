"""Times the catalogue queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma
separated; default: all).
"""

from __future__ import annotations

import json
import os
import sys
import time

from draftlake.catalogue import load
from draftlake.session import local_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(queries)
    spark.read.parquet(f"{folder}/region.parquet").count()  # session warm-up
    seconds = {}
    for n in names:
        start = time.perf_counter()
        queries[n](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.perf_counter() - start, 3)
        print(f"{n} {seconds[n]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
