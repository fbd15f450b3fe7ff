"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The derived tables are written once, in the library's layout, before timing.
Each query runs ``$BENCH_RUNS`` warm times after one cold run; a query's time is
the median of the warm ones. ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from eavista.plans.registry import run_report
from eavista.sources.tables import read_files, write_files
from verification.catalog import QUERIES
from verification.fixtures import derived_tables
from verification.session import local_session

OPERATORS = [
    "active_projects", "eav_wide", "unsigned_cast", "json_len", "ref_lookup_level",
    "ref_lookup_idea", "people_roles", "project_period", "title_fallback", "milestones",
    "deadlines", "members", "beneficiaries", "general_report", "general_filtered", "arl_report",
    "tyt_report", "stats_semester", "stats_modality", "period_list", "directores_long",
    "directores_matrix", "profesores_zip", "modalidad_dynamics", "modalidad_rollup",
    "column_widths",
]

# Reports of several sections; the others are operators above.
SECTIONED = ["estadisticas_report", "dinamica_profesores_report"]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    base = tempfile.mkdtemp(prefix="run-bench-", dir=os.environ.get("BENCH_TMP"))
    start = time.perf_counter()
    write_files(derived_tables(spark, sf_dir), base)
    setup = time.perf_counter() - start
    tables = read_files(spark, base)

    work = {name: lambda query=QUERIES[name]: run(query(tables)) for name in OPERATORS}
    for name in SECTIONED:
        work[name] = lambda name=name: [
            run(section) for section in run_report(spark, name, tables).values()
        ]
    chosen = sys.argv[1:] or list(work)
    cold, warm = {}, {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            work[name]()
            times.append(time.perf_counter() - start)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({
        "metric": "sum of median warm query seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "setup_sec": round(setup, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": spark.sparkContext.defaultParallelism,
    }))


if __name__ == "__main__":
    main()
