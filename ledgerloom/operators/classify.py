"""Description cleaning and keyword labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keywords import constant, match_label, match_priority
from ledgerloom.functions.text import strip
from ledgerloom.operators.rule_index import KEYWORDS_BROADCAST, counted_hits
from ledgerloom.rules import DisplayRules, RuleSet, display_rules, expense_rules, income_rules

# Literal replacements in order of application.
DESCRIPTION_REPLACEMENTS = {
    "purchase in terminal - mobile code": "terminal purchase",
    "web payment - mobile code": "web payment",
    "transfer from account": "account transfer",
    "transfer to account": "account deposit",
    "recipient account": "recipient",
    "phone number": "phone",
    "location: address": "location",
    "title": "description",
    "payer references": "references",
    "orlen": "Orlen gas station",
    "starbucks": "Starbucks coffee shop",
    "mcd": "McDonalds restaurant",
    "netflix": "Netflix subscription",
    "investment platform deposit": "investment deposit",
    "amazon": "Amazon shopping",
    "piotrkowska 157a": "Biedronka - Piotrkowska 157a",
    "drewnowska 58a": "Manufaktura - Drewnowska 58a",
    "pabianicka 245": "Port Łódź - Pabianicka 245",
    "maratonska 24": "Retkinia Mall - Maratońska 24",
}


def cleaned(text: Column, replacements: Mapping[str, str] = DESCRIPTION_REPLACEMENTS) -> Column:
    """Apply literal, case-sensitive replacements one after the other."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_descriptions(df: DataFrame, replacements: Mapping[str, str] = DESCRIPTION_REPLACEMENTS) -> DataFrame:
    """Replace wording in the ``data`` column; an empty mapping changes nothing."""
    return df.withColumn("data", cleaned(F.col("data"), replacements))


def expense_label(text: Column, rules: RuleSet | None = None) -> Column:
    """Expense label of a description."""
    return match_label(text, rules or expense_rules())


def income_label(text: Column, rules: RuleSet | None = None) -> Column:
    """Income label of a description."""
    return match_label(text, rules or income_rules())


def display_pair(text: Column, display: DisplayRules | None = None, rules: RuleSet | None = None) -> Column:
    """Struct ``category, importance`` of a free text."""
    display = display or display_rules()

    kind = "struct<category:string,importance:string>"
    pairs = [{"category": category, "importance": importance} for category, importance, _ in display.pairs]
    default = dict(zip(("category", "importance"), display.default, strict=True))
    position = match_priority(text, display.matching(rules or expense_rules()))
    return F.coalesce(F.get(constant(pairs, f"array<{kind}>"), position), constant(default, kind))


def with_display(df: DataFrame, label: str = "category") -> DataFrame:
    """Add ``display_category, importance`` looked up by label, with a default."""
    display = display_rules()
    # One row per label of a rule file, so always small enough to broadcast.
    pairs = display.to_dataframe(df.sparkSession, expense_rules()).withColumnRenamed("label", "_label")
    category, importance = display.default
    return (
        df.join(F.broadcast(pairs), F.col(label) == F.col("_label"), "left")
        .drop("_label")
        .fillna({"display_category": category, "importance": importance}, ["display_category", "importance"])
    )


def classify_records(df: DataFrame, item: str = "item") -> DataFrame:
    """Add ``category, importance``: the item read as a label, else as free text."""
    pairs = display_rules().to_dataframe(df.sparkSession, expense_rules())
    label = F.upper(strip(F.col(item)))
    known = df.withColumn("_label", label).join(
        F.broadcast(pairs.withColumnRenamed("label", "_label")), "_label", "left"
    )
    guessed = known.withColumn("_pair", F.when(F.col("display_category").isNull(), display_pair(F.col(item))))
    return guessed.select(
        *df.columns,
        F.coalesce("display_category", F.col("_pair.category")).alias("category"),
        F.coalesce("importance", F.col("_pair.importance")).alias("importance"),
    )


def rules_join(
    df: DataFrame, rules: DataFrame, key: str, text: str, default: str, label: str = "category"
) -> DataFrame:
    """Label texts with a rule table held in a DataFrame (``priority, label, keyword``).

    For rule tables too large to compile into an expression. Keywords are found
    in one pass over the texts (``operators.rule_index``); texts are shuffled
    only where the rules are too many to broadcast. Returns ``key`` and label.
    """
    texts = df.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    hits, count = counted_hits(texts, "_text", rules)
    best = rules.groupBy("keyword").agg(F.min(F.struct("priority", F.col("label").alias("_label"))).alias("_best"))
    best = F.broadcast(best) if count <= KEYWORDS_BROADCAST else best
    # Every key also gets the default at the lowest priority, so one aggregate
    # replaces an outer join for the texts without a hit.
    lowest = F.struct(F.lit(2**31 - 1).alias("priority"), F.lit(default).alias("_label"))
    found = df.select(key, lowest.alias("_best")).unionByName(hits.join(best, "keyword").select(key, "_best"))
    first = found.groupBy(key).agg(F.min("_best").alias("_best"))
    return first.select(key, F.col("_best._label").alias(label))
