"""Stable content-derived transaction ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import amount_value, minor_units, normalise_description, strip
from ledgerloom.operators.normalise import IMPORT_ID, INGEST_ORDER
from ledgerloom.session import configure

ALGORITHM_VERSION = "v1"
TXN_ID_LENGTH = 67

REQUIRED = {"booking_date", "amount", "data"}

# A day and amount with more rows than this is spread over several window groups.
HOT_ROWS = 1_000_000
# Days and amounts that a heavy-hitter sketch tracks, and tasks that merge sketches.
SKETCH_ITEMS = 10_000
SKETCH_MERGERS = 64
# Consecutive ingest orders that share one slice of a hot key: at most
# 2**SLICE_BITS rows, since ingest orders are distinct.
SLICE_BITS = 20

KEY = ["_booked", "_valued", "_minor", "_currency", "_type", "_text"]


def iso_date(value: Column) -> Column:
    """``YYYY-MM-DD``, or an empty string when missing or unparseable."""
    return F.coalesce(F.date_format(value.try_cast("date"), "yyyy-MM-dd"), F.lit(""))


def _tag(value: Column) -> Column:
    return F.upper(strip(F.coalesce(value.cast("string"), F.lit(""))))


def digest(*parts: Column) -> Column:
    return F.concat(F.lit(f"{ALGORITHM_VERSION}:"), F.sha2(F.concat_ws("|", *parts), 256))


def txn_id(
    booking_date: Column,
    value_date: Column,
    amount_minor: Column,
    currency: Column,
    txn_type: Column,
    description: Column,
    occurrence_index: Column,
) -> Column:
    """Id of one row from its ISO dates, minor units, raw texts and occurrence."""
    return digest(
        F.coalesce(booking_date, F.lit("")),
        F.coalesce(value_date, F.lit("")),
        amount_minor.cast("string"),
        _tag(currency),
        _tag(txn_type),
        normalise_description(description),
        occurrence_index.cast("string"),
    )


def keyed(df: DataFrame) -> DataFrame:
    """The rows with the parts of their id, the import they count in and their order."""
    missing = REQUIRED - set(df.columns)
    if missing:
        raise ValueError(f"assign_txn_ids: missing required columns {sorted(missing)}")
    configure(df.sparkSession)
    has = set(df.columns)
    numeric = isinstance(df.schema["amount"].dataType, T.NumericType)
    parts = df.withColumn("_value", amount_value(F.col("amount"), numeric)).withColumns(
        {
            "_booked": iso_date(F.col("booking_date")),
            "_valued": iso_date(F.col("value_date")) if "value_date" in has else F.lit(""),
            "_minor": minor_units(F.col("_value")),
            "_currency": _tag(F.col("currency")) if "currency" in has else F.lit("PLN"),
            "_type": _tag(F.col("txn_type")) if "txn_type" in has else F.lit(""),
            "_text": normalise_description(F.col("data")),
            "_group": F.col(IMPORT_ID) if IMPORT_ID in has else F.lit(""),
            "_order": F.col(INGEST_ORDER) if INGEST_ORDER in has else F.monotonically_increasing_id(),
        }
    )
    # A high-entropy first key lets the window's sort compare 8 bytes, not texts.
    return parts.withColumns(
        {"_hash": F.xxhash64("_group", *KEY), "_crowd": F.xxhash64("_group", "_booked", "_minor")}
    )


def hot_crowds(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Hashes ``_hot`` of the days and amounts with more than ``hot_rows`` rows.

    One narrow pass that reads neither texts nor anything else: every task keeps
    a heavy-hitter sketch, sketches are merged in two levels, and a day and
    amount that holds over a two-thousandth of all rows is never missed. At most
    ``SKETCH_ITEMS`` hashes of 8 bytes come out, so broadcasting them is safe.
    What the sketch says changes how rows are spread, never their numbers.
    """
    task = F.pmod(F.spark_partition_id(), F.lit(SKETCH_MERGERS))
    parts = rows.groupBy(task).agg(F.expr(f"approx_top_k_accumulate(_crowd, {SKETCH_ITEMS})").alias("sketch"))
    merged = parts.agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {SKETCH_ITEMS})")).alias("found"))
    return found.where(F.col("found.count") > hot_rows).select(F.col("found.item").alias("_hot"))


def occurrence_index(keyed: DataFrame, hot_rows: int = HOT_ROWS, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``occurrence``: the 0-based running count within equal keys of one import.

    One key may hold a large share of all rows (a monthly fee), so the rows of
    crowded days and amounts are cut into slices of consecutive ingest orders.
    Each slice of a key is counted on its own, and the sizes of the key's
    earlier slices are added. Other keys have a single slice and need no
    correction.
    """
    group = ["_hash", "_group", *KEY]
    hot = F.broadcast(hot_crowds(keyed, hot_rows))
    is_hot = F.col("_hot").isNotNull()
    sliced = keyed.join(hot, F.col("_crowd") == F.col("_hot"), "left").withColumn(
        "_slice", F.when(is_hot, F.shiftright("_order", slice_bits)).otherwise(F.lit(-1).cast("bigint"))
    )
    within = Window.partitionBy(*group, "_slice").orderBy("_order")
    counted = sliced.withColumn("_rank", F.row_number().over(within) - 1)
    # Only hot rows are pre-aggregated here, down to one row per key and slice.
    sizes = sliced.where(is_hot).groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.sum("_size").over(earlier).alias("_offset"))
    return (
        counted.join(offsets, [*group, "_slice"], "left")
        .withColumn("occurrence", F.col("_rank") + F.coalesce("_offset", F.lit(0)))
        .drop("_hot", "_crowd", "_value", "_slice", "_rank", "_offset")
    )


def with_occurrence(df: DataFrame, hot_rows: int = HOT_ROWS, slice_bits: int = SLICE_BITS) -> DataFrame:
    """The input rows with their ``occurrence`` and nothing else added."""
    return occurrence_index(keyed(df), hot_rows, slice_bits).select(*df.columns, "occurrence")


def assign_txn_ids(
    df: DataFrame,
    collisions: Observation | None = None,
    hot_rows: int = HOT_ROWS,
    slice_bits: int = SLICE_BITS,
) -> DataFrame:
    """Put a stable ``txn_id`` in front of every row.

    ``_ingest_order`` (distinct whole numbers) decides which of several
    identical rows gets which occurrence, ``_import_id`` restarts the count;
    both are optional. Without an order the position in the scan is taken, so
    the rows must then come straight from files or a checkpoint. ``collisions`` receives ``repeated_rows``, the number of
    rows that needed an occurrence above zero, in the same pass.
    """
    counted = occurrence_index(keyed(df), hot_rows, slice_bits)
    parts = [F.col(name).cast("string") for name in [*KEY, "occurrence"]]
    identified = counted.select(digest(*parts).alias("txn_id"), *df.columns, "occurrence")
    if collisions is not None:
        identified = identified.observe(
            collisions, F.coalesce(F.sum(F.when(F.col("occurrence") > 0, 1)), F.lit(0)).alias("repeated_rows")
        )
    return identified.drop("occurrence")
