"""The plans the operators are meant to produce."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.ids import assign_txn_ids
from ledgerloom.operators.normalise import INGEST_ORDER, normalise
from ledgerloom.operators.tracks import expense_track, label_tracks
from ledgerloom.plans.catalogue import QUERIES
from ledgerloom.sinks.tables import write_ledger

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(text: str, name: str) -> int:
    return sum(line.lstrip(" :+-*0123456789()").startswith(name) for line in text.splitlines())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "rows")
    columns = "booking_date string, value_date string, txn_type string, amount string, currency string, description string, unnamed_6 string, data string, unnamed_8 string"
    raw = spark.createDataFrame([("2025-01-01", "2025-01-01", "a", "-1", "PLN", "b", "", "c", "")], columns)
    normalise(raw).withColumn(INGEST_ORDER, F.lit(1).cast("bigint")).write.parquet(path)
    return spark.read.parquet(path)


def test_tracks_do_not_shuffle(stored):
    for text in (plan(label_tracks(stored)), plan(expense_track(stored))):
        assert nodes(text, "Exchange") == 0
        assert nodes(text, "ArrowEvalPython") == 0
        # The cleaned text is computed in one place only.
        assert text.count("maratonska 24") == 1


def test_tracks_read_only_their_columns(stored):
    schema = plan(expense_track(stored)).split("ReadSchema: ")[1]
    assert "booking_date" not in schema and "description" not in schema


def test_ids_shuffle_whole_rows_once(stored):
    text = plan(assign_txn_ids(stored))
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_slice" in line]
    # Rows once; the sizes of hot slices once more, both by the same keys.
    assert len(wide) == 2
    assert nodes(text, "ArrowEvalPython") == nodes(text, "BatchEvalPython") == 0
    assert nodes(text, "CartesianProduct") == nodes(text, "BroadcastNestedLoopJoin") == 0


def test_crowded_days_are_counted_without_reading_texts(stored):
    scans = [part.split("\n")[0] for part in plan(assign_txn_ids(stored)).split("ReadSchema: ")[1:]]
    assert any("data" not in scan for scan in scans)


@pytest.mark.parametrize("name", [name for name in QUERIES if not name.startswith("stream_") and name not in ("ledger_table", "bucketed_merge")])
def test_no_query_crosses_or_leaves_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert nodes(text, operator) == 0


def test_ledger_reads_one_track(spark, tmp_path):
    schema = "data string, amount string, day int, month int, year int"
    rows = spark.createDataFrame([("a", "-1", 1, 1, 2025), ("b", "2", 1, 2, 2025)], schema)
    write_ledger(label_tracks(rows), str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    text = plan(ledger.where("track = 'income' and year = 2025"))
    assert "PartitionFilters: [isnotnull(track" in text
