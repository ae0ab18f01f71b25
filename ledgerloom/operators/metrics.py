"""Previews, row counts and import quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import is_missing, readable_double
from ledgerloom.operators.classify import cleaned, expense_label, income_label
from ledgerloom.operators.normalise import IMPORT_ID
from ledgerloom.operators.tracks import EXPENSE, INCOME
from ledgerloom.rules import DEFAULT_EXPENSE, DEFAULT_INCOME, REFUND_LABEL

PREVIEW_ROWS = 50
NO_TRACK = "none"


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The first rows, with all columns; in a defined order if one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def is_longer_than(df: DataFrame, rows: int = PREVIEW_ROWS) -> bool:
    """Whether a preview of that many rows leaves something out."""
    return not df.offset(rows).limit(1).isEmpty()


def counted(df: DataFrame, rows: Observation) -> DataFrame:
    """Report the row count as ``rows`` of the observation, in the same pass."""
    return df.observe(rows, F.count(F.lit(1)).alias("rows"))


def import_quality(rows: DataFrame) -> DataFrame:
    """How many rows of every import pass which gate, with totals.

    Takes normalised rows; ``occurrence`` (``operators.ids``) and the import's
    name are optional. One row per import and ``track``, one per import and one
    for all, told apart by ``level`` (``track``, ``import``, ``all``), where
    what is summed over is null. Rows that no track takes - refunds, missing and
    unreadable amounts - have the track ``none``. Counts: ``rows``,
    ``missing_amounts`` (null or not a number), ``unreadable_amounts`` (which
    stop an import), ``refunds``, ``undated``, ``without_text``, ``unlabelled``
    (the track's default label) and ``repeated_rows``. Rows are combined before
    the shuffle, so it moves a few rows per import and task.
    """
    data, amount = F.col("data"), F.col("amount")
    numeric = isinstance(rows.schema["amount"].dataType, T.NumericType)
    value = amount.cast("double") if numeric else readable_double(amount)
    flags = rows.select(
        (F.col(IMPORT_ID) if IMPORT_ID in rows.columns else F.lit("")).alias("import_id"),
        value.alias("value"),
        (F.lit(False) if numeric else amount.isNotNull() & value.isNull()).alias("unreadable"),
        cleaned(data).alias("data"),
        F.col("booking_date").isNull().alias("undated"),
        ((F.col("occurrence") if "occurrence" in rows.columns else F.lit(0)) > 0).alias("repeated"),
    )
    labelled = flags.withColumn("spending", expense_label(F.col("data"))).withColumn(
        "refund", F.col("spending") == REFUND_LABEL
    )
    kept = ~F.col("refund") & ~is_missing(F.col("value"))
    track = F.when(~kept, F.lit(NO_TRACK)).when(F.col("value") > 0, F.lit(INCOME)).otherwise(F.lit(EXPENSE))
    income = F.when(track == INCOME, income_label(F.col("data")) == DEFAULT_INCOME)
    routed = labelled.withColumn("track", track).withColumn(
        "unlabelled", F.coalesce(income, F.when(track == EXPENSE, F.col("spending") == DEFAULT_EXPENSE), F.lit(False))
    )
    counts = {
        "rows": F.lit(True),
        "missing_amounts": is_missing(F.col("value")) & ~F.col("unreadable"),
        "unreadable_amounts": F.col("unreadable"),
        "refunds": F.col("refund"),
        "undated": F.col("undated"),
        "without_text": F.col("data") == "",
        "unlabelled": F.col("unlabelled"),
        "repeated_rows": F.col("repeated"),
    }
    sets = [["import_id", "track"], ["import_id"], []]
    columns = [[F.col(name) for name in names] for names in sets]
    grouped = routed.groupingSets(columns, F.col("import_id"), F.col("track")).agg(
        F.grouping_id().alias("_summed"), *[F.count_if(flag).alias(name) for name, flag in counts.items()]
    )
    level = F.when(F.col("_summed") == 0, F.lit("track")).when(F.col("_summed") == 1, F.lit("import")).otherwise(F.lit("all"))
    return grouped.select(level.alias("level"), "import_id", "track", *counts)
