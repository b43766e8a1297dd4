"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no driver-side collection) twice,
after one warm-up query; ``queries`` holds the faster of the two runs (steady state: code
generated and JIT-compiled, as in a long-running service), ``first_run`` the first run
(including code generation for that plan shape). Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {name: sec}, "sf": ...,
 "first_run_total": sec, "first_run": {name: sec}}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notewise.plans.portfolio import QUERIES  # noqa: E402
from notewise.session import local_session  # noqa: E402


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="notewise-bench")
    run(QUERIES["note_summary"](spark, sf_dir))  # warm-up: JVM, codegen, file listing
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(q(spark, sf_dir))
            samples.append(round(time.perf_counter() - t0, 3))
        first[name] = samples[0]
        times[name] = min(samples)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": _sf(sf_dir),
        "first_run_total": round(sum(first.values()), 3),
        "first_run": first,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
