from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from ledgerloom.operators.tracks import (
    EXPENSE,
    INCOME,
    PROCESSED_COLUMNS,
    drop_refunds,
    expense_track,
    income_track,
    label_tracks,
    only_track,
)
from ledgerloom.rules import RuleSet

SCHEMA = "data string, amount string, day int, month int, year int, txn_id string"


def frame(spark, *rows):
    return spark.createDataFrame([(data, amount, 15, 1, 2023, "id") for data, amount in rows], SCHEMA)


def pairs(df, *names):
    return sorted(tuple(row[name] for name in names) for row in df.collect())


ROWS = [
    ("biedronka", "-50.0"),
    ("Zwrot biedronka", "-10.0"),
    ("REFUND", "20"),
    ("nothing", "0"),
    ("nothing", "-0.0"),
    ("wynagrodzenie", "5200.00"),
    ("biedronka", "7"),
    ("zwrot podatku", "700"),
    ("orlen", "NaN"),
    ("orlen", None),
    ("orlen", "-inf"),
    ("bonus", "inf"),
    ("mcd", "-10000000"),
    ("x", "1e308"),
]


def test_expenses(spark):
    track = expense_track(frame(spark, *ROWS))
    assert track.columns == PROCESSED_COLUMNS
    assert dict(track.dtypes)["amount"] == "string"
    assert pairs(track, "data", "amount", "category") == [
        ("McDonalds restaurant", "10000000.0", "FASTFOOD"),
        ("Orlen gas station", "inf", "FUEL"),
        ("biedronka", "50.0", "FOOD"),
        ("nothing", "0.0", "MISC"),
        ("nothing", "0.0", "MISC"),
    ]


def test_income(spark):
    track = income_track(frame(spark, *ROWS))
    assert track.columns == PROCESSED_COLUMNS
    assert pairs(track, "data", "amount", "category") == [
        ("biedronka", "7.0", "INCOME_MISC"),
        ("bonus", "inf", "EXTRA_INCOME"),
        ("wynagrodzenie", "5200.0", "SALARY"),
        ("x", "1e+308", "INCOME_MISC"),
    ]


def test_one_pass_equals_both_tracks(spark):
    rows = frame(spark, *ROWS)
    labelled = label_tracks(rows)
    assert pairs(only_track(labelled, EXPENSE), *PROCESSED_COLUMNS) == pairs(expense_track(rows), *PROCESSED_COLUMNS)
    assert pairs(only_track(labelled, INCOME), *PROCESSED_COLUMNS) == pairs(income_track(rows), *PROCESSED_COLUMNS)


def test_missing_amounts_are_counted_without_refunds(spark):
    dropped = Observation("dropped")
    expense_track(frame(spark, *ROWS, ("zwrot", None)), dropped=dropped).collect()
    assert dropped.get == {"missing_amounts": 2}


@pytest.mark.parametrize("amount", ["not_a_number", "abc", "", "1,50"])
def test_unreadable_amounts_fail_unless_refunded(spark, amount):
    with pytest.raises(PySparkException, match="amount is not a number"):
        expense_track(frame(spark, ("shop", amount))).collect()
    assert expense_track(frame(spark, ("zwrot", amount))).collect() == []
    assert income_track(frame(spark, ("Refund", amount))).collect() == []


def test_numeric_amounts_and_missing_ids(spark):
    rows = frame(spark, ("biedronka", "-1.5")).selectExpr("data", "double(amount) amount", "day", "month", "year")
    assert expense_track(rows).first().asDict() == {
        "txn_id": "",
        "day": 15,
        "month": 1,
        "year": 2023,
        "amount": "1.5",
        "category": "FOOD",
        "data": "biedronka",
    }


def test_rows_without_a_label_stay(spark):
    rows = spark.createDataFrame([("FOOD",), ("REMOVE_ENTRY",), (None,)], "category string")
    assert {row.category for row in drop_refunds(rows).collect()} == {"FOOD", None}


def test_empty_rules_and_replacements(spark):
    rules = RuleSet((), "MISC")
    track = expense_track(frame(spark, ("orlen zwrot", "-1")), replacements={}, rules=rules)
    assert pairs(track, "data", "category") == [("orlen zwrot", "MISC")]


def test_refund_label_with_lower_priority(spark):
    rules = RuleSet((("FOOD", ("lidl",)), ("REMOVE_ENTRY", ("zwrot",)), ("FUEL", ("orlen",))), "MISC")
    track = expense_track(frame(spark, ("lidl zwrot", "-1"), ("orlen zwrot", "-1"), ("orlen", "-1")), rules=rules)
    assert pairs(track, "category") == [("FOOD",), ("FUEL",)]


def test_empty_input(spark):
    assert expense_track(frame(spark)).collect() == []
    assert label_tracks(frame(spark)).columns == ["track", *PROCESSED_COLUMNS]


def test_payloads_survive(spark):
    payloads = ["'; DROP TABLE x; --", "<script>alert(1)</script>", "a\0b", "../../etc", "${jndi:x}", "‮abc", "%s%n"]
    track = expense_track(frame(spark, *[(payload, "-1") for payload in payloads]))
    assert {row.data for row in track.collect()} == set(payloads)


def test_out_of_range_dates_pass(spark):
    rows = spark.createDataFrame([("x", "-1", 99, 13, -5, "id")], SCHEMA)
    assert expense_track(rows).select("day", "month", "year").first() == (99, 13, -5)


def test_random_rows_keep_the_contract(spark):
    generator = random.Random(3)
    rows = [
        ("".join(chr(generator.randint(1, 0xD7FF)) for _ in range(generator.randint(1, 40))), f"-{generator.uniform(0, 1e6):.2f}")
        for _ in range(500)
    ]
    track = expense_track(frame(spark, *rows))
    found = track.collect()
    refunds = sum(any(word in data.lower() for word in ("zwrot", "refund")) for data, _ in rows)
    assert len(found) == len(rows) - refunds
    assert all(float(row.amount) >= 0 for row in found)
