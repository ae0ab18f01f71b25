"""Copies of transactions that a stream delivers again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.streaming.running_ids import use_rocksdb

DELAY = "7 days"


def without_late_copies(identified: DataFrame, arrived: str, delay: str = DELAY) -> DataFrame:
    """A stream of identified rows without copies that arrive within ``delay`` of the first one.

    ``arrived`` is the time of arrival, not of booking: it only grows, so the
    watermark never drops a row that is new. State holds the ids of about two
    delays and shrinks as the watermark moves on, however long the stream runs.
    A copy that comes later than that passes, and is left to the merge with the
    ledger (``operators.merge``), which knows every id.
    """
    use_rocksdb(identified.sparkSession)
    timed = identified.withColumn(arrived, F.col(arrived).cast("timestamp"))
    return timed.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["txn_id"])
