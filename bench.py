"""Benchmark: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (timed runs per query, median reported; default 1),
BENCH_QUERIES (comma list to override the headline set).
The pipeline stages (catalogue import, sentences, polarity, spans, aspect
rows, dictionary) are built first and timed one by one (``build_*``); the
headline queries then run over the stage tables into Spark's ``noop`` sink
(no driver collect). One untimed warm-up on sf0.001 precedes the timing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlake.plans.catalog import QUERIES  # noqa: E402
from reviewlake.plans.pipeline import STAGES, Pipeline  # noqa: E402
from reviewlake.session import build_session  # noqa: E402

# Stage builds (``build_*``) are the headline; the queries after them compute
# something beyond the stage tables.
HEADLINE = [
    "review_features",         # flagship: joins polarity, spans and aspect rows into wide features
    "preprocessed_features",   # the flagship on cleaned sentences
    "normalize_full",          # X1-X6 on whole texts
    "replace_metadata",        # X7-X9
    "sample_sentences",        # W1 (top-k per group)
    "sentence_parts",          # W5
    "name_branches",           # U2
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(f"local[{cpus}]", app="reviewlake-bench", shuffle_partitions=cpus * 2)
    warm = Pipeline(spark, "/root/testdata/sf0.001")      # warm-up: JIT and codegen caches
    warm.build()
    run(QUERIES[names[0]](warm))
    p = Pipeline(spark, sf_dir)
    times: dict[str, float] = {}
    for stage in STAGES:
        t0 = time.perf_counter()
        getattr(p, stage)
        times[f"build_{stage}"] = round(time.perf_counter() - t0, 3)
    for name in names:
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(QUERIES[name](p))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
