"""Helpers the corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch_folder

# Texts that one step of a Python task handles together, in characters.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends."""
    return written(df, purpose)[1]


def written(df: DataFrame, purpose: str) -> tuple[str, DataFrame]:
    """As ``checkpointed``, with the path, for tables that are to be removed again."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that nothing reads any more; later tables must have been written themselves."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a whole column; one pass that only adds."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(size: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


def text_slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch with their texts, null as empty, of bounded total length."""
    values = batch.column(batch.schema.get_field_index(column))
    start, size, texts = 0, 0, []
    for row in range(len(values)):
        text = values[row].as_py() or ""
        if texts and size + len(text) > chars:
            yield start, row, texts
            start, size, texts = row, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, len(values), texts
