"""Expense and income tracks: cleaning, labelling, amount gates and routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.keywords import contains_any, match_label
from ledgerloom.functions.text import float_text, is_missing, strict_double
from ledgerloom.operators.classify import DESCRIPTION_REPLACEMENTS, cleaned
from ledgerloom.rules import REFUND_LABEL, RuleSet, expense_rules, income_rules

PROCESSED_COLUMNS = ["txn_id", "day", "month", "year", "amount", "category", "data"]

EXPENSE = "expense"
INCOME = "income"


def with_txn_id(df: DataFrame) -> DataFrame:
    """Add an empty ``txn_id`` where ids were not assigned."""
    return df if "txn_id" in df.columns else df.withColumn("txn_id", F.lit(""))


def drop_refunds(df: DataFrame) -> DataFrame:
    """Drop rows labelled as refunds; rows without a label stay."""
    return df.where(~F.col("category").eqNullSafe(REFUND_LABEL))


def _refund(text: Column, rules: RuleSet) -> Column:
    """Whether the expense rules would label the text as a refund.

    The refund label has top priority, so its own keywords decide.
    """
    if REFUND_LABEL not in rules.labels:
        return F.lit(False)
    ranked = rules.labels.index(REFUND_LABEL)
    if ranked:
        return match_label(text, RuleSet(rules.rules[: ranked + 1], rules.default)) == REFUND_LABEL
    return contains_any(F.coalesce(F.lower(text), F.lit("")), rules.keywords(REFUND_LABEL))


def _labelled(
    df: DataFrame,
    replacements: Mapping[str, str],
    rules: RuleSet,
    wanted: Callable[[Column], Column],
    label: Callable[[Column, Column], Column],
    dropped: Observation | None,
) -> DataFrame:
    """Cleaned and labelled rows that are no refunds and whose amount is wanted.

    Adds ``_value``, the amount as a number. It is parsed only where the row is
    not a refund, so an unreadable amount on a refund does not fail.

    A generator that yields a label for wanted rows and nothing for the others
    takes the place of a filter: filters on cleaned text or labels would be
    pushed below the projections and repeat that work for every reference.
    """
    numeric = isinstance(df.schema["amount"].dataType, T.NumericType)
    amount = F.col("amount").cast("double") if numeric else strict_double(F.col("amount"))
    data, value, refund = F.col("data"), F.col("_value"), F.col("_refund")
    rows = (
        with_txn_id(df)
        .withColumn("data", cleaned(data, replacements))
        .withColumn("_refund", _refund(data, rules))
        .withColumn("_value", F.when(~refund, amount))
    )
    if dropped is not None:
        rows = rows.observe(dropped, F.count_if(~refund & is_missing(value)).alias("missing_amounts"))
    kept = ~refund & ~is_missing(value) & wanted(value)
    others = [name for name in rows.columns if name not in ("category", "_refund")]
    return rows.select(*others, F.explode(F.when(kept, F.array(label(data, value)))).alias("category"))


def expense_track(
    df: DataFrame,
    replacements: Mapping[str, str] = DESCRIPTION_REPLACEMENTS,
    rules: RuleSet | None = None,
    dropped: Observation | None = None,
) -> DataFrame:
    """Labelled expenses (amounts of zero and below, as positive text)."""
    rules = rules or expense_rules()
    spendings = rules.without(REFUND_LABEL)
    rows = _labelled(
        df, replacements, rules, lambda value: value <= 0, lambda data, _: match_label(data, spendings), dropped
    )
    return rows.withColumn("amount", float_text(F.abs("_value"))).select(*PROCESSED_COLUMNS)


def income_track(
    df: DataFrame,
    replacements: Mapping[str, str] = DESCRIPTION_REPLACEMENTS,
    rules: RuleSet | None = None,
    incomes: RuleSet | None = None,
    dropped: Observation | None = None,
) -> DataFrame:
    """Labelled income (positive amounts as text), refunds by the expense rules removed."""
    rules, incomes = rules or expense_rules(), incomes or income_rules()
    rows = _labelled(
        df, replacements, rules, lambda value: value > 0, lambda data, _: match_label(data, incomes), dropped
    )
    return rows.withColumn("amount", float_text(F.col("_value"))).select(*PROCESSED_COLUMNS)


def label_tracks(
    df: DataFrame,
    replacements: Mapping[str, str] = DESCRIPTION_REPLACEMENTS,
    rules: RuleSet | None = None,
    incomes: RuleSet | None = None,
    dropped: Observation | None = None,
) -> DataFrame:
    """Both tracks in one pass, told apart by a ``track`` column.

    Routes by sign before labelling, so each row meets one rule set only.
    Bookkeeping and date columns are kept next to the processed ones.
    """
    rules, incomes = rules or expense_rules(), incomes or income_rules()
    spendings = rules.without(REFUND_LABEL)

    def label(data: Column, value: Column) -> Column:
        return F.when(value > 0, match_label(data, incomes)).otherwise(match_label(data, spendings))

    rows = _labelled(df, replacements, rules, lambda value: F.lit(True), label, dropped)
    track = F.when(F.col("_value") > 0, F.lit(INCOME)).otherwise(F.lit(EXPENSE))
    rest = [name for name in df.columns if name not in PROCESSED_COLUMNS]
    return rows.withColumn("amount", float_text(F.abs("_value"))).select(
        track.alias("track"), *PROCESSED_COLUMNS, *rest
    )


def only_track(labelled: DataFrame, track: str) -> DataFrame:
    """The processed columns of one track of ``label_tracks``."""
    return labelled.where(F.col("track") == track).select(*PROCESSED_COLUMNS)
