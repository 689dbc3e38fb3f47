"""Headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tropicast.plans import load_all  # noqa: E402
from tropicast.session import build_session  # noqa: E402

HEADLINE = ("flagship", "a6", "c6", "g1", "w9", "e3", "j6", "n2", "n3", "n6", "n13", "v21", "v30", "v37", "r1", "m1")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", "bench", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                          spark_driver_memory="16g",
                          spark_checkpoint_dir=os.path.join(tempfile.mkdtemp(prefix="bench-"), "shared"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    # start the JVM's code paths and the Python workers outside the measurement
    queries["flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["n1"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
