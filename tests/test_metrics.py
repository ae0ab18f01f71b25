from __future__ import annotations

from ledgerloom.operators.metrics import import_quality
from ledgerloom.operators.normalise import IMPORT_ID

SCHEMA = f"booking_date string, amount string, data string, occurrence long, {IMPORT_ID} string"


def by_place(df):
    return {(row.level, row.import_id, row.track): row.asDict() for row in df.collect()}


def test_gate_counts_and_totals(spark):
    rows = [
        ("2025-01-01", "-5", "biedronka", 0, "a"),
        ("2025-01-01", "-5", "biedronka", 1, "a"),
        (None, "-1", "nothing known", 0, "a"),
        ("2025-01-01", "7", "nothing known", 0, "a"),
        ("2025-01-01", "NaN", "x", 0, "a"),
        ("2025-01-01", None, "", 0, "b"),
        ("2025-01-01", "5,0", "x", 0, "b"),
        ("2025-01-01", "junk", "zwrot", 0, "b"),
    ]
    found = by_place(import_quality(spark.createDataFrame(rows, SCHEMA)))
    assert set(found) == {
        ("track", "a", "expense"), ("track", "a", "income"), ("track", "a", "none"), ("track", "b", "none"),
        ("import", "a", None), ("import", "b", None), ("all", None, None),
    }
    spent = found["track", "a", "expense"]
    assert (spent["rows"], spent["repeated_rows"], spent["unlabelled"], spent["undated"]) == (3, 1, 1, 1)
    second = found["import", "b", None]
    counts = ("rows", "missing_amounts", "unreadable_amounts", "refunds", "without_text", "unlabelled")
    assert [second[name] for name in counts] == [3, 1, 2, 1, 1, 0]
    total = found["all", None, None]
    assert [total[name] for name in counts] == [8, 2, 2, 1, 1, 2]


def test_numeric_amounts_without_imports_or_counts(spark):
    rows = spark.createDataFrame([("2025-01-01", 1.0, "x"), ("2025-01-01", float("nan"), "x")], "booking_date string, amount double, data string")
    found = by_place(import_quality(rows))
    assert found["all", None, None]["missing_amounts"] == 1 and found["all", None, None]["repeated_rows"] == 0
    assert found["track", "", "income"]["rows"] == 1


def test_empty_table_gives_a_total_of_nothing(spark):
    found = import_quality(spark.createDataFrame([], SCHEMA)).collect()
    assert [(row.level, row.rows) for row in found] in ([], [("all", 0)])
