"""Benchmark the eleven reports.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
(default 8).

Setup (timed separately as ``setup_sec``): derive the eight report tables from
the driver's files and store them as a deployment would (``hist_tb``
partitioned by event day, every table in several files) under
``$BENCH_WORK_DIR`` (default, for this local master only: a new folder under /tmp;
with another master, set in $BENCH_MASTER, the folder must be given and be shared).

Per report: build the plan over the stored tables and run it into the
``noop`` sink; one warm-up round, then the median of ``$BENCH_RUNS``
(default 3) timed runs. The same reports run directly over the driver's files
(tables derived on the fly) are reported as ``queries_from_driver_files``.

Prints one JSON line: {"metric", "value" (sum of medians), "unit", "queries",
"sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dunning.params import FIXTURE_PARAMS  # noqa: E402
from dunning.plans.reports import REPORTS  # noqa: E402
from dunning.session import local_session  # noqa: E402
from dunning.sources.layout import HIST_PARTITION, write_tables  # noqa: E402
from dunning.sources.tables import from_fixture, from_parquet  # noqa: E402


def run_once(spark, tables, key: str) -> float:
    t0 = time.perf_counter()
    REPORTS[key].build(tables, FIXTURE_PARAMS).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def medians(spark, tables, runs: int) -> dict[str, float]:
    for key in REPORTS:  # warm-up
        run_once(spark, tables, key)
    out = {}
    for key in REPORTS:
        times = [run_once(spark, tables, key) for _ in range(runs)]
        out[key] = round(statistics.median(times), 4)
        print(f"{key}: {out[key]:.3f}s {[round(x, 3) for x in times]}", file=sys.stderr)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    master = os.environ.get("BENCH_MASTER", f"local[{cpus}]")
    work = os.environ.get("BENCH_WORK_DIR")
    if not work:
        if not master.startswith("local["):
            sys.exit("BENCH_WORK_DIR must name a shared folder when the master is not local")
        work = tempfile.mkdtemp(prefix="dunning-bench-")
    spark = local_session(shuffle_partitions=cpus, app="dunning-bench", master=master)

    t0 = time.perf_counter()
    write_tables(from_fixture(spark, sf_dir), f"{work}/tables", files=cpus)
    setup = time.perf_counter() - t0

    print("stored tables:", file=sys.stderr)
    stored = medians(spark, from_parquet(spark, f"{work}/tables", hist_day=HIST_PARTITION), runs)
    print("driver files:", file=sys.stderr)
    direct = medians(spark, from_fixture(spark, sf_dir), runs)
    spark.stop()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "reports_total_median_sec",
                "value": round(sum(stored.values()), 4),
                "unit": "sec",
                "queries": stored,
                "sf": float(m.group(1)) if m else sf_dir,
                "setup_sec": round(setup, 3),
                "queries_from_driver_files": direct,
                "total_from_driver_files": round(sum(direct.values()), 4),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
