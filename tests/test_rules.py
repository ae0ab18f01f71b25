from __future__ import annotations

import pytest

from ledgerloom.rules import (
    RULE_SCHEMA,
    RuleSet,
    display_rules,
    expense_rules,
    income_rules,
    lint_rules,
    load_rules,
)


def test_sizes_and_order():
    expense, income = expense_rules(), income_rules()
    assert len(expense.rules) == 35
    assert sum(len(keywords) for _, keywords in expense.rules) == 314
    assert expense.labels[0] == "REMOVE_ENTRY"
    assert expense.labels[-1] == "SHOPPING"
    assert expense.default == "MISC"
    assert [len(keywords) for _, keywords in income.rules] == [4, 4, 5]
    assert income.default == "INCOME_MISC"


def test_every_label_has_a_display_pair():
    pairs = display_rules().by_label(expense_rules())
    assert set(pairs) == {*expense_rules().labels, "MISC"}
    assert pairs["REMOVE_ENTRY"] == pairs["MISC"] == ("Misc", "Needs Review")
    assert pairs["FASTFOOD"][1] == "Shouldn't Have"
    assert len({category for category, _ in pairs.values()}) == 16


def test_shipped_rules_are_clean(spark):
    for rules in (expense_rules(), income_rules()):
        assert lint_rules(rules.to_dataframe(spark)).collect() == []


def test_lint_finds_every_problem(spark):
    rows = [
        (0, "A", "cat"),
        (1, "B", "cat"),
        (1, "B", "concatenate"),
        (2, "C", "Upper"),
        (3, "D", "123"),
        (4, "E", ""),
        (5, "F", "dog"),
        (5, "F", "doghouse"),
    ]
    found = lint_rules(spark.createDataFrame(rows, RULE_SCHEMA))
    assert {(row.problem, row.label, row.keyword) for row in found.collect()} == {
        ("listed twice", "A", "cat"),
        ("inside another keyword", "A", "cat"),
        ("not lower case", "C", "Upper"),
        ("digits only", "D", "123"),
        ("empty", "E", ""),
    }


def test_rule_files(tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text("# note\nONE: a b | c\nREST:\n", encoding="utf-8")
    assert load_rules(path) == RuleSet((("ONE", ("a b", "c")),), "REST")
    path.write_text("ONE: a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no default label"):
        load_rules(path)
    with pytest.raises(ValueError, match="empty keyword"):
        RuleSet((("ONE", ("",)),), "REST")
