"""Raw nine-column bank export to the normalised transaction schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a bank export by position, and of normalised rows.
RAW_COLUMNS = [
    "booking_date",
    "value_date",
    "txn_type",
    "amount",
    "currency",
    "description",
    "unnamed_6",
    "data",
    "unnamed_8",
]
NORMALISED_COLUMNS = [
    "booking_date",
    "value_date",
    "txn_type",
    "amount",
    "currency",
    "description",
    "data",
    "month",
    "year",
    "day",
]
# Order in which the text columns are merged.
MERGED_COLUMNS = ["txn_type", "description", "unnamed_6", "unnamed_8", "data"]

# Bookkeeping columns added by the sources travel along untouched.
IMPORT_ID = "_import_id"
INGEST_ORDER = "_ingest_order"
BOOKKEEPING = [IMPORT_ID, INGEST_ORDER]


def bookkeeping(df: DataFrame) -> list[str]:
    return [name for name in BOOKKEEPING if name in df.columns]


def strict_date(value: Column) -> Column:
    """Date of a text, date or timestamp; a non-blank unparseable text fails."""
    parsed = value.try_cast("date")
    broken = parsed.isNull() & (F.trim(value.cast("string")) != "")
    failure = F.raise_error(F.lit("booking_date is not a date")).cast("date")
    return F.when(F.coalesce(broken, F.lit(False)), failure).otherwise(parsed)


def merged_text(*texts: Column) -> Column:
    """Join lower-cased texts with ``//``; blanks and ``nan`` leave no trace."""
    known = [F.when(text == "nan", F.lit("")).otherwise(F.coalesce(text, F.lit(""))) for text in texts]
    joined = F.regexp_replace(F.concat_ws("//", *known), "/{2,}", "//")
    return F.btrim(joined, F.lit("/"))


def normalise(df: DataFrame) -> DataFrame:
    """Rename nine columns by position, parse dates, lower-case and merge the text."""
    kept = bookkeeping(df)
    raw = [name for name in df.columns if name not in kept]
    if len(raw) != len(RAW_COLUMNS):
        raise ValueError(f"a bank export has exactly {len(RAW_COLUMNS)} columns, got {len(raw)}")
    # Columns are matched by position: header names carry no meaning.
    names = iter(RAW_COLUMNS)
    named = df.toDF(*[name if name in kept else next(names) for name in df.columns])
    lowered = named.withColumns(
        {name: F.lower(F.col(name).cast("string")) for name in MERGED_COLUMNS}
        | {
            "booking_date": strict_date(F.col("booking_date")),
            "value_date": F.col("value_date").try_cast("date"),
        }
    )
    return lowered.select(
        "booking_date",
        "value_date",
        "txn_type",
        "amount",
        "currency",
        "description",
        merged_text(*[F.col(name) for name in MERGED_COLUMNS]).alias("data"),
        F.month("booking_date").alias("month"),
        F.year("booking_date").alias("year"),
        F.dayofmonth("booking_date").alias("day"),
        *kept,
    )
