"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of Parquet tables, ``BENCH_CPUS`` the number
of local cores, ``BENCH_QUERIES`` optionally a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerloom.plans.catalogue import QUERIES

HEADLINE = [
    "normalise_import",
    "clean_descriptions",
    "categorise_documents",
    "classify_display",
    "rules_broadcast_join",
    "lineitem_tracks",
    "lineitem_txn_ids",
    "occurrence_index",
    "reimport_merge",
    "track_route",
    "extract_location",
    "unassigned_expenses",
    "sheets_expenses",
    "bank_csv_import",
    "ledger_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["clean_descriptions"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(Path(folder).name.removeprefix("sf")),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
