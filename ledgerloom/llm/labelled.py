"""Bounded labelled samples and held-out rows for the trained scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    per_class: int,
    max_chars: int,
    id_column: str = "doc_id",
    text: str = "text",
) -> list[tuple[str, int]]:
    """Texts and labels (0 or 1) to learn from: at most ``per_class`` rows a class.

    Rows are taken in the order of a hash of their id, so the sample does not
    depend on how the tables are split. Rows of the held-out remainder, null
    labels and texts over ``max_chars`` are never learned from, and no other
    column is read. What reaches the driver is at most
    ``2 * per_class * max_chars`` characters.
    """
    key, mark = F.col(id_column), F.col(label).cast("int")
    known = labels.select(key.alias("id"), mark.alias("mark")).where(
        F.col("id").isNotNull() & F.col("mark").isin(0, 1) & (remainder(F.col("id"), modulus) != held_out)
    )
    merged = known.groupBy("id").agg(F.max("mark").alias("mark"))
    rows = []
    for value in (0, 1):
        # Twice the rows, as some will be too long; sorted rows beyond the limit never leave their task.
        chosen = merged.where(F.col("mark") == value).orderBy(F.xxhash64("id"), "id").limit(2 * per_class)
        texts = documents.select(key.alias("id"), F.col(text).alias("text")).where(F.length("text") <= max_chars)
        found = texts.join(F.broadcast(chosen), "id").select("id", "text", "mark")
        rows += found.orderBy(F.xxhash64("id"), "id", "text").limit(per_class).collect()
    return [(row["text"], row["mark"]) for row in rows]
