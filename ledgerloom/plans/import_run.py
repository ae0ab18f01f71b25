"""From bank files to the ledger table and its six hand-off exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession

from ledgerloom.operators.ids import assign_txn_ids
from ledgerloom.operators.metrics import counted
from ledgerloom.operators.normalise import BOOKKEEPING, normalise
from ledgerloom.operators.tracks import EXPENSE, INCOME, label_tracks, only_track
from ledgerloom.session import configure
from ledgerloom.sinks import tables
from ledgerloom.sources.bank_csv import read_bank_csv


@dataclass(frozen=True)
class ImportReport:
    """Row counts gathered while the ledger was written."""

    rows: int
    repeated_rows: int
    missing_amounts: int


def run_import(spark: SparkSession, source: str | list[str], target: str, encoding: str | None = None) -> ImportReport:
    """Read bank files, write ``target/ledger`` and the exports next to it.

    The ledger is written first, in one job that evaluates every quality gate;
    the exports read it back, each only the partitions of its track. A broken
    input therefore fails before any export exists, and no export repeats the
    import.
    """
    configure(spark)
    repeated, missing, rows = Observation("repeated"), Observation("missing"), Observation("rows")
    files = read_bank_csv(spark, source, encoding)
    ids = assign_txn_ids(normalise(files.rows), collisions=repeated)
    labelled = counted(label_tracks(ids, dropped=missing).drop(*BOOKKEEPING), rows)
    tables.write_ledger(labelled, f"{target}/ledger")
    tables.write_csv(files.skipped.select("record"), f"{target}/skipped_records")

    ledger = spark.read.parquet(f"{target}/ledger")
    expenses, incomes = only_track(ledger, EXPENSE), only_track(ledger, INCOME)
    tables.write_unassigned_expenses(expenses, f"{target}/unassigned_transactions")
    tables.write_expense_sheet(expenses, f"{target}/google_sheets_expenses")
    tables.write_cleaned(expenses, f"{target}/processed_transactions")
    tables.write_unassigned_income(incomes, f"{target}/unassigned_income")
    tables.write_income_sheet(incomes, f"{target}/google_sheets_income")
    tables.write_cleaned(incomes, f"{target}/processed_income")
    return ImportReport(
        rows=rows.get["rows"],
        repeated_rows=repeated.get["repeated_rows"],
        missing_amounts=missing.get["missing_amounts"],
    )
