"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Bank files come in windows-1250, which Spark 4 only decodes with the legacy
# charset list; dates and amounts are compared in UTC and with ANSI casts.
SETTINGS = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


SPLIT_COUNT = "spark.sql.files.minPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every plan in this package relies on.

    Row positions are compared between scans of the same files, so the splits
    must not follow the number of executors that happen to be up: their number
    is fixed once per session unless the cluster sets it.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(SPLIT_COUNT, None) is None:
        spark.conf.set(SPLIT_COUNT, str(spark.sparkContext.defaultParallelism))
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """Return a fresh folder for a written intermediate table.

    The parent is the shared folder named by ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to the machine's own
    temporary folder: on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
