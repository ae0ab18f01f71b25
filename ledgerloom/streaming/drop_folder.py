"""Incremental imports: new bank files folded into a ledger table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ids import assign_txn_ids
from ledgerloom.operators.merge import new_rows
from ledgerloom.operators.normalise import normalise
from ledgerloom.operators.tracks import label_tracks
from ledgerloom.session import configure
from ledgerloom.sources.bank_csv import read_bank_csv

FILES_PER_BATCH = 1000
MOST_MONTHS = 600
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger folder as a table, or None before its first batch."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _in_months_of(dated: DataFrame) -> Column:
    """Condition that prunes a ledger to the months of a batch.

    Batches that touch very many months are compared with the whole ledger.
    """
    months = dated.select("year", "month").distinct().limit(MOST_MONTHS + 1).collect()
    if len(months) > MOST_MONTHS:
        return F.lit(True)
    by_year: dict[int | None, list[int]] = {}
    for year, month in months:
        by_year.setdefault(year, []).append(month)
    wanted = F.lit(False)
    for year, of_year in by_year.items():
        wanted |= F.col("year").isNull() if year is None else (F.col("year") == year) & F.col("month").isin(of_year)
    return wanted


def fold_import(labelled: DataFrame, dated: DataFrame, ledger: str, stream: str, batch: int) -> None:
    """Write the rows of one batch whose ids the ledger lacks.

    Each batch owns one folder and is compared with all others, so a batch that
    is run again after a failure replaces its own output and nothing else.
    Equal ids have equal booking dates, so only the ledger's partitions of the
    batch's months are read. ``dated`` holds the batch's ``year, month`` and is
    cheap to read, such as the rows before ids and labels were added.
    """
    spark = labelled.sparkSession
    stored = read_ledger(spark, ledger)
    if stored is not None:
        others = stored.where(~((F.col("stream") == stream) & (F.col("batch") == batch)))
        fresh = new_rows(labelled, others.where(_in_months_of(dated)))
    else:
        fresh = new_rows(labelled, labelled.limit(0))
    target = f"{ledger}/stream={stream}/batch={batch}"
    fresh.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(target)


def _fold_normalised(rows: DataFrame, ledger: str, stream: str, batch: int) -> None:
    fold_import(label_tracks(assign_txn_ids(rows)), rows, ledger, stream, batch)


def import_frames(
    frames: DataFrame,
    ledger: str,
    checkpoint: str,
    stream: str = "frames",
    prepare: Callable[[DataFrame], DataFrame] = normalise,
) -> StreamingQuery:
    """Fold a stream of rows into the ledger; ``prepare`` yields normalised rows."""
    configure(frames.sparkSession)

    def fold(batch: DataFrame, number: int) -> None:
        _fold_normalised(prepare(batch), ledger, stream, number)

    return (
        frames.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def import_files(
    spark: SparkSession,
    folder: str,
    ledger: str,
    checkpoint: str,
    stream: str = "files",
    encoding: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    pattern: str = "*.csv",
    available_now: bool = True,
) -> StreamingQuery:
    """Watch a folder and fold every new bank file into the ledger.

    The stream carries file names only; the files themselves are read by the
    batch reader, so charsets, skipped rows and ids are those of a batch import.
    A ledger may be fed by several streams with different names.
    """
    configure(spark)
    names = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def fold(batch: DataFrame, number: int) -> None:
        # At most files_per_batch names.
        files = [row.path for row in batch.collect()]
        if files:
            _fold_normalised(normalise(read_bank_csv(spark, files, encoding).rows), ledger, stream, number)

    writer = names.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
