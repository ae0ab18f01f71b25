"""Location enrichment of rows no rule labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.location import (
    tidy_location,
    first_location,
    map_link,
    restore_diacritics,
    split_parts,
)


def with_location(df: DataFrame, data: str = "data") -> DataFrame:
    """Add ``extracted_location`` and ``google_maps_link``.

    Intermediate values are columns of their own, so each is computed once.
    """
    return (
        df.withColumn("_parts", split_parts(F.col(data)))
        .withColumn("_raw", first_location(F.col("_parts")))
        .withColumn("_tidy", tidy_location(F.col("_raw")))
        .withColumn("extracted_location", restore_diacritics(F.col("_tidy")))
        .withColumn("google_maps_link", map_link(F.col("extracted_location")))
        .drop("_parts", "_raw", "_tidy")
    )
