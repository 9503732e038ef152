"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Stored tables (articles, vocabulary, staging, landing folders) are built in a
fresh namespace first and timed as ``build_tables``; each query is then
executed in full with the ``noop`` sink (no driver collect).  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    from lexmine.session import local_session
    from lexmine.plans import queries as Q
    from lexmine.plans import tables

    spark = local_session(cpus, app="lexmine-bench", extra={"spark.lexmine.tables.namespace": f"bench-{uuid.uuid4().hex[:8]}"})
    times: dict[str, float] = {}

    # warm-up: JVM, Python workers and the parquet footers of the inputs
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").write.format("noop").mode("overwrite").save()

    t0 = time.time()
    tables.articles(spark, sf_dir)
    tables.vocab(spark, sf_dir)
    times["build_tables"] = round(time.time() - t0, 3)

    for name, fn in Q.REGISTRY.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
