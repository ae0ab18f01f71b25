"""Processed CSV files read back by header name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.classify import classify_records
from ledgerloom.sources.bank_csv import files_by, header_census

RECORD_COLUMNS = ["month", "year", "item", "amount", "category", "importance"]


def read_processed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records ``month, year, item, amount`` (text) with ``category, importance``.

    Columns are found by name, in any order, in every file by its own header:
    one scan reads all files that share a header, and the scans are united by
    name. A file without one of the columns is an error; other columns are left
    out, a byte order mark is ignored, and files without any line give nothing.
    """
    names = {"month": "month", "year": "year", "item": "category", "amount": "amount"}
    census = header_census(spark, path).where(F.col("header").isNotNull())
    scans = []
    for files in files_by(census, "header").values():
        table = spark.read.option("header", True).option("escape", '"').csv(files)
        scans.append(table.select(*[F.coalesce(F.col(name), F.lit("")).alias(as_) for as_, name in names.items()]))
    if not scans:
        raise ValueError(f"no header in {path}")
    return classify_records(reduce(DataFrame.unionByName, scans)).select(*RECORD_COLUMNS)
