"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import remove_written, written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected to) from links ``a``, ``b``.

    Each round a node takes the smallest root among its own and its neighbours',
    then the root of that root; distances to the smallest node so shrink by
    more than half. Only minima are gathered, so a node with many neighbours is
    pre-aggregated where its links lie. Every round ends in a written table, and the one before is removed.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    edges_path, edges = written(both, "links")
    first = edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    path, roots = written(first, "roots")
    while True:
        seen = edges.join(roots.select(F.col("node").alias("other"), "root"), "other").select("node", "root")
        nearest = seen.union(roots).groupBy("node").agg(F.min("root").alias("root"))
        hop = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = nearest.join(hop, "root", "left").select("node", F.least("root", "next").alias("root"))
        next_path, following = written(jumped, "roots")
        changed = following.join(roots.withColumnRenamed("root", "before"), "node").where("root <> before")
        settled = changed.isEmpty()
        remove_written(links.sparkSession, path)
        path, roots = next_path, following
        if settled:
            remove_written(links.sparkSession, edges_path)
            return roots
