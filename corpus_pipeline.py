"""The corpus pipeline: stages that hand documents on, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import checkpointed, table
from ledgerloom.llm.decontaminate import without_contaminated
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.simhash import without_near_duplicates
from ledgerloom.llm.suffix_dedup import without_repeats
from ledgerloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return without_near_duplicates(docs, shingle_words=3, max_bits=3)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in a document with a smaller id are cut out."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark window occurs in go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into windows; one row per piece."""
    return pack_documents(docs, longest=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("repeated-strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Scores of a trained model, fingerprints and packings have no SQL form; the
# tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
