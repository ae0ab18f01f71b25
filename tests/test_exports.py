from __future__ import annotations

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import review
from ledgerloom.operators.metrics import is_longer_than, preview
from ledgerloom.plans.import_run import run_import
from ledgerloom.sinks import tables
from ledgerloom.sources.processed import read_processed
from tests.test_ids import KNOWN_IDS
from tests.test_sources import HEADER, bank_line

SCHEMA = "txn_id string, day int, month int, year int, amount string, category string, data string"


def processed(spark, *rows):
    return spark.createDataFrame([("id", 15, 1, 2023, *row) for row in rows], SCHEMA)


def raw_files(folder: Path) -> list[bytes]:
    return [path.read_bytes() for path in sorted(folder.glob("part-*")) if path.stat().st_size]


def read_rows(folder: Path, sep: str = ",") -> list[list[str]]:
    """Header once, then the rows of all parts, read by Python's own CSV reader."""
    header, rows = None, []
    for content in raw_files(folder):
        text = content.decode("utf-8-sig")
        first, *rest = list(csv.reader(text.splitlines(keepends=True), delimiter=sep))
        assert header in (None, first)
        header = first
        rows += rest
    return [header, *sorted(rows)]


def test_expense_sheet(spark, tmp_path):
    rows = processed(spark, ("50.0", "FOOD", "x"), ("1234.5", "FASTFOOD", "x"), ("1.0", "OTHER", "x"))
    tables.write_expense_sheet(rows, str(tmp_path / "s"))
    assert read_rows(tmp_path / "s", "\t") == [
        review.SHEET_COLUMNS,
        ["id", "15", "1", "2023", "FASTFOOD", "☠ Self Destruction", "1234,5", "Shouldn't Have"],
        ["id", "15", "1", "2023", "FOOD", "🥦 Food", "50,0", "Essential"],
        ["id", "15", "1", "2023", "OTHER", "Misc", "1,0", "Needs Review"],
    ]
    assert not raw_files(tmp_path / "s")[0].startswith(b"\xef\xbb\xbf")


def test_income_sheet(spark, tmp_path):
    tables.write_income_sheet(processed(spark, ("5200.0", "SALARY", "x")), str(tmp_path / "s"))
    assert read_rows(tmp_path / "s", "\t")[1] == ["id", "15", "1", "2023", "SALARY", "SALARY", "5200,0", ""]


def test_negative_sheet_amounts_are_guarded(spark):
    rows = review.sheet(processed(spark, ("-10.0", "=X", "x")), review.expense_rows)
    assert rows.select("Amount", "Item").first() == ("'-10,0", "'=X")


def test_custom_sheet_rows(spark):
    def shouting(df):
        return review.expense_rows(df).withColumn("Category", F.upper("Category"))

    assert review.sheet(processed(spark, ("1.0", "FOOD", "x")), shouting).first().Category == "🥦 FOOD"


def test_cleaned_rows_have_a_byte_order_mark(spark, tmp_path):
    tables.write_cleaned(processed(spark, ("50.0", "FOOD", "x")).drop("txn_id"), str(tmp_path / "c"))
    content = raw_files(tmp_path / "c")[0]
    assert content.startswith(b"\xef\xbb\xbftxn_id,day,month,year,category,amount\n")
    assert read_rows(tmp_path / "c")[1] == ["", "15", "1", "2023", "FOOD", "50.0"]
    assert read_processed(spark, str(tmp_path / "c")).first().item == "FOOD"


def test_unassigned_expenses(spark):
    rows = review.unassigned_expenses(
        processed(
            spark,
            ("1.0", "MISC", "shop - ul. Polna 4, Lodz"),
            ("1.0", "OTHER_MISC", "=cmd"),
            ("1.0", "FOOD", "x"),
            ("1.0", None, "x"),
        )
    )
    assert rows.columns == review.UNASSIGNED_EXPENSE_COLUMNS
    found = {row.data: (row.extracted_location, row.google_maps_link) for row in rows.collect()}
    assert set(found) == {"shop - ul. Polna 4, Lodz", "'=cmd"}
    assert found["'=cmd"] == ("'=cmd", "")
    assert found["shop - ul. Polna 4, Lodz"][0] == "ul. Polna 4, łódź"


def test_unassigned_income(spark):
    rows = review.unassigned_income(
        processed(spark, ("1.0", "INCOME_MISC", "a"), ("1.0", "MY_INCOME_MISC", "b"), ("1.0", "SALARY", "c"))
    )
    assert rows.columns == review.UNASSIGNED_INCOME_COLUMNS
    assert [row.data for row in rows.collect()] == ["a"]


def test_hostile_cells_round_trip(spark, tmp_path):
    cells = ["\t=tabbed", "\r=cr", " lead", "trail ", 'q"uote', "a,b", "two\nlines", "back\\slash", "#x", "'", "ł🥦"]
    tables.write_unassigned_income(processed(spark, *[("1.0", "INCOME_MISC", cell) for cell in cells]), str(tmp_path / "u"))
    found = []
    for content in raw_files(tmp_path / "u"):
        lines = content.decode("utf-8-sig").replace("\r=", "<CR>=")
        found += [row[6] for row in csv.reader(lines.splitlines(keepends=True))][1:]
    expected = ["'\t=tabbed", "'<CR>=cr", *cells[2:]]
    assert sorted(found) == sorted(expected)


def test_empty_input_still_writes_headers(spark, tmp_path):
    empty = processed(spark)
    for name, write, header in (
        ("a", tables.write_expense_sheet, "\t".join(review.SHEET_COLUMNS)),
        ("b", tables.write_cleaned, ",".join(review.CLEANED_COLUMNS)),
        ("c", tables.write_unassigned_expenses, ",".join(review.UNASSIGNED_EXPENSE_COLUMNS)),
    ):
        write(empty, str(tmp_path / name))
        assert [content.decode("utf-8-sig").strip() for content in raw_files(tmp_path / name)] == [header]


def test_preview(spark):
    rows = spark.range(60)
    assert [row.id for row in preview(rows, 3, ["id"]).collect()] == [0, 1, 2]
    assert is_longer_than(rows) and not is_longer_than(rows, 60)


def test_import_run(spark, tmp_path):
    lines = [
        f'"{day}","{day}","{kind}","{amount}","PLN","{text}","{extra}","{place}",""\n'
        for day, kind, amount, text, extra, place in KNOWN_IDS
    ]
    lines.append('"2025-04-15","2025-04-15","Przelew na rachunek","700.00","PLN","Zwrot podatku PIT-37","","",""\n')
    lines += [lines[0], bank_line("x").replace("\n", ',"more"\n')]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bank.csv").write_bytes((HEADER + "".join(lines)).encode("cp1250"))
    report = run_import(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (report.rows, report.repeated_rows, report.missing_amounts) == (len(KNOWN_IDS) + 1, 1, 0)

    out = tmp_path / "out"
    ledger = spark.read.parquet(str(out / "ledger"))
    assert {row.txn_id for row in ledger.collect()} > set(KNOWN_IDS.values())
    assert [row.name for row in sorted(out.glob("ledger/track=*"))] == ["track=expense", "track=income"]
    cleaned = read_rows(out / "processed_transactions")
    assert cleaned[0] == review.CLEANED_COLUMNS
    assert len(cleaned) == 7
    assert [row[4] for row in read_rows(out / "processed_income")[1:]] == ["EXTRA_INCOME", "SALARY"]
    places = {row[7] for row in read_rows(out / "unassigned_transactions")[1:]}
    assert places == {"ul. piotrkowska 146, łódź", "ul. źródlana, warszawa"}
    assert len(read_rows(out / "google_sheets_income", "\t")) == 3
    assert read_rows(out / "unassigned_income") == [review.UNASSIGNED_INCOME_COLUMNS]
    assert len(read_rows(out / "google_sheets_expenses", "\t")) == 7
    assert len(read_rows(out / "skipped_records")) == 2


@pytest.mark.parametrize("broken", ["abc", ""])
def test_broken_import_writes_no_export(spark, tmp_path, broken):
    (tmp_path / "bank.csv").write_text(HEADER + bank_line("x") + bank_line("y", broken))
    with pytest.raises(Exception, match="amount is"):
        run_import(spark, str(tmp_path / "bank.csv"), str(tmp_path / "out"))
    assert not list(tmp_path.glob("out/*/part-*"))
