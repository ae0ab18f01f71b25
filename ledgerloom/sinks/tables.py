"""Hand-off CSV files and the partitioned ledger table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators import review

BYTE_ORDER_MARK = "\ufeff"
LEDGER_PARTITIONS = ["track", "year", "month"]


def write_csv(df: DataFrame, path: str, sep: str = ",", mark: bool = False) -> None:
    """Write a folder of CSV files with a header each; nulls and empty texts alike.

    Blanks at the ends of a value are kept: trimming them would turn a guarded
    cell back into a formula. ``mark`` puts a byte order mark before the header.
    """
    if mark:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_expense_sheet(df: DataFrame, path: str) -> None:
    write_csv(review.sheet(df, review.expense_rows), path, sep="\t")


def write_income_sheet(df: DataFrame, path: str) -> None:
    write_csv(review.sheet(df, review.income_rows), path, sep="\t")


def write_cleaned(df: DataFrame, path: str) -> None:
    write_csv(review.cleaned_rows(df), path, mark=True)


def write_unassigned_expenses(df: DataFrame, path: str) -> None:
    write_csv(review.unassigned_expenses(df), path, mark=True)


def write_unassigned_income(df: DataFrame, path: str) -> None:
    write_csv(review.unassigned_income(df), path, mark=True)


def write_ledger(labelled: DataFrame, path: str) -> None:
    """Write both tracks as Parquet by track, year and month.

    The rebalance hint lets adaptive execution merge small months and split
    large ones, so neither tiny files nor one overloaded task come out of it.
    """
    labelled.hint("rebalance", *LEDGER_PARTITIONS).write.mode("overwrite").partitionBy(*LEDGER_PARTITIONS).parquet(path)
