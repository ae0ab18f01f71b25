"""Projections handed to spreadsheets and reviewers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import sheet_guard
from ledgerloom.operators.classify import with_display
from ledgerloom.operators.location import with_location
from ledgerloom.operators.tracks import PROCESSED_COLUMNS, with_txn_id
from ledgerloom.rules import DEFAULT_EXPENSE, DEFAULT_INCOME

SHEET_COLUMNS = ["Txn_Id", "Day", "Month", "Year", "Item", "Category", "Amount", "Importance"]
CLEANED_COLUMNS = ["txn_id", "day", "month", "year", "category", "amount"]
UNASSIGNED_EXPENSE_COLUMNS = [*PROCESSED_COLUMNS, "extracted_location", "google_maps_link"]
UNASSIGNED_INCOME_COLUMNS = PROCESSED_COLUMNS


def guard_sheet(df: DataFrame) -> DataFrame:
    """Defuse spreadsheet formulas in every text column."""
    return df.select(
        *[
            sheet_guard(F.col(f"`{field.name}`")).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


def _sheet(df: DataFrame, category: str, importance: str) -> DataFrame:
    return df.select(
        F.col("txn_id").alias("Txn_Id"),
        F.col("day").alias("Day"),
        F.col("month").alias("Month"),
        F.col("year").alias("Year"),
        F.col("category").alias("Item"),
        F.col(category).alias("Category"),
        F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")).alias("Amount"),
        F.col(importance).alias("Importance"),
    )


def expense_rows(df: DataFrame) -> DataFrame:
    """Sheet rows of expenses: display category, importance, decimal comma."""
    return _sheet(with_display(with_txn_id(df)), "display_category", "importance")


def income_rows(df: DataFrame) -> DataFrame:
    """Sheet rows of income: the label twice, no importance."""
    return _sheet(with_txn_id(df).withColumn("_none", F.lit("")), "category", "_none")


def sheet(df: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sheet export built by any function that yields the sheet columns."""
    return guard_sheet(rows(df).select(*SHEET_COLUMNS))


def cleaned_rows(df: DataFrame) -> DataFrame:
    """Reporting columns of either track."""
    return guard_sheet(with_txn_id(df).select(*CLEANED_COLUMNS))


def unassigned_expenses(df: DataFrame) -> DataFrame:
    """Expenses whose label contains MISC, with location and map link."""
    open_rows = with_txn_id(df).where(F.coalesce(F.contains("category", F.lit(DEFAULT_EXPENSE)), F.lit(False)))
    return guard_sheet(with_location(open_rows).select(*UNASSIGNED_EXPENSE_COLUMNS))


def unassigned_income(df: DataFrame) -> DataFrame:
    """Income rows with the default label."""
    open_rows = with_txn_id(df).where(F.col("category") == DEFAULT_INCOME)
    return guard_sheet(open_rows.select(*UNASSIGNED_INCOME_COLUMNS))
