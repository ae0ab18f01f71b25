"""Merging overlapping imports by transaction id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.normalise import bookkeeping


def first_per_id(df: DataFrame) -> DataFrame:
    """One row per ``txn_id``: the one from the earliest import and position.

    Rows are shuffled and sorted once, by the id, which is the order that a join
    on the id wants as well. Within an import no id repeats, so an id has at
    most as many copies as there are imports.
    """
    others = [name for name in df.columns if name != "txn_id"]
    first = Window.partitionBy("txn_id").orderBy(*(bookkeeping(df) or others))
    # A lag rather than a row number: the limit that Spark derives from the
    # latter sorts whole rows before the shuffle too.
    marked = df.withColumn("_earlier", F.lag(F.lit(True)).over(first))
    return marked.where(F.col("_earlier").isNull()).drop("_earlier")


def new_rows(imported: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of an import whose id the ledger does not hold yet."""
    return first_per_id(imported).join(ledger.select("txn_id"), "txn_id", "left_anti").select(*imported.columns)


def merge_import(ledger: DataFrame, imported: DataFrame) -> DataFrame:
    """The ledger plus the new rows of an import."""
    return ledger.unionByName(new_rows(imported, ledger))


def open_bucketed_ledger(spark: SparkSession, name: str, path: str, like: DataFrame, buckets: int) -> DataFrame:
    """The ledger in ``path`` as table ``name``, laid out in buckets of ``txn_id``.

    Creates the table in the session's catalogue where it is missing, over
    whatever files ``path`` holds, so a ledger outlives the catalogue. ``like``
    gives the columns. ``buckets`` belongs to the files: it must be the same
    each time, and large enough that one bucket fits a task's memory.
    """
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in like.schema)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{place}' "
        f"CLUSTERED BY (txn_id) SORTED BY (txn_id) INTO {buckets} BUCKETS"
    )
    return spark.table(name)


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows in the partitions that a table of so many buckets has."""
    return rows.repartition(buckets, "txn_id")


def bucketed_new_rows(imported: DataFrame, ledger: DataFrame, buckets: int) -> DataFrame:
    """Rows of an import whose id a bucketed ledger lacks.

    Only the import is shuffled, straight into the ledger's buckets; each bucket
    of the ledger is read by the task that needs it. Copies of an id number at
    most one per import, so no id is hot.
    """
    return new_rows(_placed(imported, buckets), ledger)


def append_bucketed(rows: DataFrame, name: str, buckets: int) -> None:
    """Add rows to a bucketed ledger, one file a bucket.

    Appending the new rows of an import twice adds nothing the second time, as
    ``bucketed_new_rows`` finds them in the ledger then.
    """
    writer = _placed(rows, buckets).write.mode("append").format("parquet")
    writer.bucketBy(buckets, "txn_id").sortBy("txn_id").saveAsTable(name)


def merge_bucketed(imported: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Fold an import into the bucketed ledger in ``path`` and return the whole ledger."""
    ledger = open_bucketed_ledger(imported.sparkSession, name, path, imported, buckets)
    append_bucketed(bucketed_new_rows(imported, ledger, buckets), name, buckets)
    return imported.sparkSession.table(name)
