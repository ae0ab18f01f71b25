"""Keyword rule sets: ordered labels with their keywords, read from text files.

Rule files are read once on the driver while a plan is built; executors only
ever see the expressions compiled from them (``functions.keywords``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOURCES = Path(__file__).parent / "resources"

REFUND_LABEL = "REMOVE_ENTRY"
DEFAULT_EXPENSE = "MISC"
DEFAULT_INCOME = "INCOME_MISC"

# A rule set is compiled into every task's expressions, so it stays small.
MAX_RULE_KEYWORDS = 100_000

RULE_SCHEMA = "priority int, label string, keyword string"


@dataclass(frozen=True)
class RuleSet:
    """Labels in priority order, each with its keywords, and a default label."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    default: str

    def __post_init__(self) -> None:
        for label, keywords in self.rules:
            if any(not keyword for keyword in keywords):
                raise ValueError(f"label {label!r} has an empty keyword")
        total = sum(len(keywords) for _, keywords in self.rules)
        if total > MAX_RULE_KEYWORDS:
            raise ValueError(f"{total} keywords exceed the limit of {MAX_RULE_KEYWORDS}; use rules_join instead")

    @property
    def labels(self) -> list[str]:
        return [label for label, _ in self.rules]

    def keywords(self, label: str) -> tuple[str, ...]:
        return dict(self.rules)[label]

    def only(self, *labels: str) -> RuleSet:
        return RuleSet(tuple(rule for rule in self.rules if rule[0] in labels), self.default)

    def without(self, *labels: str) -> RuleSet:
        return RuleSet(tuple(rule for rule in self.rules if rule[0] not in labels), self.default)

    def rows(self) -> list[tuple[int, str, str]]:
        return [
            (priority, label, keyword)
            for priority, (label, keywords) in enumerate(self.rules)
            for keyword in keywords
        ]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """One row per keyword: ``priority, label, keyword``."""
        return spark.createDataFrame(self.rows(), RULE_SCHEMA)


@dataclass(frozen=True)
class DisplayRules:
    """Display pairs ``(category, importance)`` in matching order."""

    pairs: tuple[tuple[str, str, tuple[str, ...]], ...]
    default: tuple[str, str]

    def matching(self, expense: RuleSet) -> RuleSet:
        """Rule set over free text whose labels are the positions of the pairs."""
        merged = tuple(
            (str(position), tuple(keyword for label in labels for keyword in expense.keywords(label)))
            for position, (_, _, labels) in enumerate(self.pairs)
        )
        return RuleSet(merged, str(len(self.pairs)))

    def by_label(self, expense: RuleSet) -> dict[str, tuple[str, str]]:
        """Display pair of every expense label, unmapped labels included."""
        display = dict.fromkeys([*expense.labels, expense.default], self.default)
        for category, importance, labels in self.pairs:
            display.update(dict.fromkeys(labels, (category, importance)))
        return display

    def to_dataframe(self, spark: SparkSession, expense: RuleSet) -> DataFrame:
        """One row per expense label: ``label, display_category, importance``."""
        rows = [(label, *pair) for label, pair in self.by_label(expense).items()]
        return spark.createDataFrame(rows, "label string, display_category string, importance string")


def _lines(path: str | Path) -> list[str]:
    text = Path(path).read_text(encoding="utf-8")
    return [line for line in text.splitlines() if line.strip() and not line.startswith("#")]


def load_rules(path: str | Path) -> RuleSet:
    """Read a rule file; the label without keywords is the default."""
    rules, default = [], ""
    for line in _lines(path):
        label, _, listed = line.partition(":")
        keywords = tuple(word.strip() for word in listed.split("|") if word.strip())
        if keywords:
            rules.append((label.strip(), keywords))
        else:
            default = label.strip()
    if not default:
        raise ValueError(f"{path}: no default label (a label without keywords)")
    return RuleSet(tuple(rules), default)


def load_display_rules(path: str | Path) -> DisplayRules:
    """Read display rules; the line without labels is the default pair."""
    pairs, default = [], None
    for line in _lines(path):
        category, importance, listed = (part.strip() for part in line.split("|"))
        labels = tuple(label.strip() for label in listed.split(",") if label.strip())
        if labels:
            pairs.append((category, importance, labels))
        else:
            default = (category, importance)
    if default is None:
        raise ValueError(f"{path}: no default pair (a pair without labels)")
    return DisplayRules(tuple(pairs), default)


@cache
def expense_rules() -> RuleSet:
    return load_rules(RESOURCES / "expense_rules.txt")


@cache
def income_rules() -> RuleSet:
    return load_rules(RESOURCES / "income_rules.txt")


@cache
def display_rules() -> DisplayRules:
    return load_display_rules(RESOURCES / "display_rules.txt")


def lint_rules(rules: DataFrame, short: int = 4) -> DataFrame:
    """Report rule rows that break the taxonomy's own conventions.

    Takes ``priority, label, keyword`` and returns ``problem, label, keyword,
    other_label, other_keyword``. Keywords listed under two labels and short
    keywords hidden in another label's longer keyword are found with equi-joins
    on the keyword and on the longer keyword's substrings.
    """
    none = F.lit(None).cast("string")
    single = rules.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("keyword") == "", F.lit("empty")),
                    F.when(F.lower("keyword") != F.col("keyword"), F.lit("not lower case")),
                    F.when(F.col("keyword").rlike("^[0-9]+$"), F.lit("digits only")),
                ),
                lambda problem: problem.isNotNull(),
            )
        ).alias("problem"),
        "label",
        "keyword",
        none.alias("other_label"),
        none.alias("other_keyword"),
    )
    repeated = (
        rules.groupBy("keyword")
        .agg(F.sort_array(F.collect_set("label")).alias("labels"))
        .where(F.size("labels") > 1)
        .select(
            F.lit("listed twice").alias("problem"),
            F.col("labels")[0].alias("label"),
            "keyword",
            F.col("labels")[1].alias("other_label"),
            F.col("keyword").alias("other_keyword"),
        )
    )
    length = F.length("keyword")
    pieces = rules.where(length > 1).select(
        F.col("label").alias("other_label"),
        F.col("keyword").alias("other_keyword"),
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.least(F.lit(short), length - 1)),
                        lambda size: F.transform(
                            F.sequence(F.lit(1), F.length("keyword") - size + 1),
                            lambda start: F.substring("keyword", start, size),
                        ),
                    )
                )
            )
        ).alias("keyword"),
    )
    hidden = (
        rules.where(length <= short)
        .join(pieces, "keyword")
        .where(F.col("label") != F.col("other_label"))
        .select(F.lit("inside another keyword").alias("problem"), "label", "keyword", "other_label", "other_keyword")
    )
    return single.unionByName(repeated).unionByName(hidden)
