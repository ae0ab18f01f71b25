from __future__ import annotations

import csv
import gzip
import io
import random

import pytest
from pyspark.errors import AnalysisException

from ledgerloom.operators.normalise import IMPORT_ID, INGEST_ORDER, NORMALISED_COLUMNS, normalise
from ledgerloom.sources.bank_csv import charset_order, files_by, header_census, probe_files, read_bank_csv
from ledgerloom.sources.processed import read_processed

HEADER = "Data operacji,Data waluty,Typ transakcji,Kwota,Waluta,Opis transakcji,unnamed_6,data,unnamed_8\n"
POLISH = "Żółw pod Świdnicą ąęśćźńł"


def bank_line(text: str, amount: str = "-1.00") -> str:
    return f'"2025-01-02","2025-01-03","Zakup","{amount}","PLN","{text}","","",""\n'


def texts(rows) -> list[str]:
    return [row[5] for row in rows.orderBy(IMPORT_ID, INGEST_ORDER).collect()]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1250", "iso-8859-2"])
def test_charset_is_found(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes((HEADER + bank_line(POLISH)).encode(encoding))
    # Every byte of this text is also windows-1250, so ISO-8859-2 must be asked for.
    wanted = encoding if encoding == "iso-8859-2" else None
    assert texts(read_bank_csv(spark, str(tmp_path), wanted).rows) == [POLISH]


def test_last_charset_is_reached(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes((HEADER + bank_line("Ł\x81")).encode("iso-8859-2"))
    assert texts(read_bank_csv(spark, str(tmp_path)).rows) == ["Ł\x81"]


def test_each_file_has_its_own_charset(spark, tmp_path):
    folder = tmp_path / "bank files"
    folder.mkdir()
    for number, encoding in enumerate(("utf-8", "cp1250", "utf-8-sig")):
        (folder / f"f+{number} [{number}] {{x}}%20.csv").write_bytes((HEADER + bank_line(POLISH) * 2).encode(encoding))
    files = read_bank_csv(spark, str(folder))
    assert texts(files.rows) == [POLISH] * 6
    assert files.rows.select(IMPORT_ID).distinct().count() == 3
    assert files.rows.select(IMPORT_ID, INGEST_ORDER).distinct().count() == 6


def test_requested_charset_goes_first(spark, tmp_path):
    assert charset_order(None) == ["UTF-8", "windows-1250", "ISO-8859-2"]
    assert charset_order("CP1250") == ["windows-1250", "UTF-8", "ISO-8859-2"]
    assert charset_order("latin-1") == charset_order("iso_8859_1") == charset_order(None)
    with pytest.raises(ValueError, match="unsupported encoding"):
        charset_order("utf-16")
    # "Ł" in UTF-8 holds a byte windows-1250 lacks, "ą" does not.
    (tmp_path / "a.csv").write_bytes((HEADER + bank_line("Łódź")).encode())
    (tmp_path / "b.csv").write_bytes((HEADER + bank_line("ą")).encode())
    picked = {row.file[-5:]: row.charset for row in probe_files(spark, str(tmp_path), "cp1250").collect()}
    assert picked == {"a.csv": "UTF-8", "b.csv": "windows-1250"}
    assert {row.charset for row in probe_files(spark, str(tmp_path)).collect()} == {"UTF-8"}


def test_long_rows_are_set_aside_and_short_rows_padded(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "data,amount,month,year\n"
        "good,-10.0,1,2023\n"
        "bad,-20.0,1,2023,EXTRA\n"
        "bad,-20.0,1,2023,\n"
        "bad,-20.0,1,2023,,\n"
        "short,-1\n"
        '"quo,ted, with, many",-2.0,1,2023\n'
        '"say ""a,b""",-2.0,1,2023\n'
        "good2,-30.0,2,2023\n"
        "\n"
        '"short, but, with, commas"\n'
    )
    files = read_bank_csv(spark, str(tmp_path))
    rows = files.rows.orderBy(INGEST_ORDER).collect()
    assert [row.data for row in rows] == [
        "good",
        "short",
        "quo,ted, with, many",
        'say "a,b"',
        "good2",
        "short, but, with, commas",
    ]
    assert rows[1][:4] == ("short", "-1", None, None)
    assert [row.record for row in files.skipped.orderBy(INGEST_ORDER).collect()] == [
        "bad,-20.0,1,2023,EXTRA",
        "bad,-20.0,1,2023,",
        "bad,-20.0,1,2023,,",
    ]


def test_column_pruning_changes_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n1,2,3,4\n1\n")
    rows = read_bank_csv(spark, str(tmp_path)).rows
    assert rows.count() == 2
    assert sorted(str(row.b) for row in rows.select("b").collect()) == ["2", "None"]


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "plain.csv").write_text(HEADER + bank_line("one"))
    (tmp_path / "wrapped.csv").write_text(HEADER + bank_line("two\nlines, ok") + bank_line("three"))
    multiline = {row.file.rsplit("/", 1)[1]: row.multiline for row in probe_files(spark, str(tmp_path)).collect()}
    assert multiline == {"plain.csv": False, "wrapped.csv": True}
    files = read_bank_csv(spark, str(tmp_path))
    assert texts(files.rows) == ["one", "two\nlines, ok", "three"]
    assert files.skipped.count() == 0


def test_stray_quotes_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n12" pizza,1\nx,"2"\nit"s,"two\nlines"\n5" y,3\n"""q""","""\n"\nz,""\n')
    (tmp_path / "b.csv").write_text('a,b\n7" only,8\n')
    multiline = {row.file[-5:]: row.multiline for row in probe_files(spark, str(tmp_path)).collect()}
    assert multiline == {"a.csv": True, "b.csv": False}
    rows = read_bank_csv(spark, str(tmp_path)).rows.orderBy(IMPORT_ID, INGEST_ORDER).collect()
    assert [row[:2] for row in rows] == [
        ('12" pizza', "1"),
        ("x", "2"),
        ('it"s', "two\nlines"),
        ('5" y', "3"),
        ('"q"', '"\n'),
        ("z", None),
        ('7" only', "8"),
    ]


@pytest.mark.parametrize("split_bytes", [60, 333, 10**8])
@pytest.mark.parametrize("charset, line_end", [("utf-8-sig", "\n"), ("cp1250", "\r\n")])
def test_records_across_splits(spark, tmp_path, split_bytes, charset, line_end):
    generator = random.Random(split_bytes)
    rows = []
    for number in range(120):
        text = "".join(generator.choice(["a", "Ż", ",", '"', "\n", "\n\n", " ", "b" * 40]) for _ in range(8))
        rows.append([f"{number}", text.strip() or "x", generator.choice(["", "plain", "y\nz"])])
    for name, part in (("a.csv", rows[:70]), ("b.csv", rows[70:])):
        buffer = io.StringIO()
        writer = csv.writer(buffer, lineterminator="\n")
        writer.writerow(["no", "long\nname", "note"])
        writer.writerows(part)
        (tmp_path / name).write_bytes(("\n" + buffer.getvalue()).replace("\n", line_end).encode(charset))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        files = read_bank_csv(spark, str(tmp_path))
        found = files.rows.orderBy(IMPORT_ID, INGEST_ORDER).collect()
        assert files.skipped.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert files.rows.columns[0] == "no"
    assert sorted(([row[0], row[1], row[2] or ""] for row in found), key=lambda row: int(row[0])) == rows
    assert [row.no for row in found] == [row[0] for row in rows]


def test_gzip_and_line_end_styles(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wb") as target:
        target.write((HEADER + bank_line(POLISH)).replace("\n", "\r\n").encode("cp1250"))
    assert texts(read_bank_csv(spark, str(tmp_path)).rows) == [POLISH]


def test_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c,d\nNA,n/a,"null",""\n<NA>,x,NULL,none\n')
    rows = read_bank_csv(spark, str(tmp_path)).rows.orderBy(INGEST_ORDER).collect()
    assert [row[:4] for row in rows] == [(None, None, None, None), (None, "x", None, "none")]


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_bank_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no lines"):
        read_bank_csv(spark, str(tmp_path))


def test_wrong_number_of_columns(spark, tmp_path):
    for line in ("a,b,c,d,e,f,g\n", "a,b,c,d,e,f,g,h,i,j\n"):
        (tmp_path / "a.csv").write_text(line + line.upper())
        with pytest.raises(ValueError, match="exactly 9 columns"):
            normalise(read_bank_csv(spark, str(tmp_path)).rows)


def test_normalise(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER
        + '"2025-09-01","PLN","Zakup W","-50.00","PLN","Biedronka//X","","Lok/","/Z/"\n'
        + '"2025-09-30","2025-10-01","","7.5","PLN","NaN","nan","NAN",""\n'
        + ',,"a","1","PLN","b","c","d","e"\n'
    )
    rows = normalise(read_bank_csv(spark, str(tmp_path)).rows).orderBy(INGEST_ORDER)
    assert rows.columns[:10] == NORMALISED_COLUMNS
    first, second, third = rows.collect()
    assert (str(first.booking_date), first.value_date, first.day, first.month, first.year) == ("2025-09-01", None, 1, 9, 2025)
    assert first.data == "zakup w//biedronka//x//z//lok"
    assert (second.data, str(second.value_date), second.amount) == ("", "2025-10-01", "7.5")
    assert (third.booking_date, third.data) == (None, "a//b//c//e//d")


def test_bad_booking_date_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + bank_line("x").replace("2025-01-02", "yesterday"))
    with pytest.raises(Exception, match="booking_date is not a date"):
        normalise(read_bank_csv(spark, str(tmp_path)).rows).collect()


def test_blank_dates_are_missing(spark):
    raw = spark.createDataFrame([("", " ", "a", "1", "PLN", "b", "c", "d", "e")], ", ".join(f"c{n} string" for n in range(9)))
    assert normalise(raw).select("booking_date", "value_date", "year").first() == (None, None, None)


def test_processed_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "txn_id,amount,category,year,month\nx,5.0,FOOD,2025,9\ny,1.0,my kebab,2025,10\n", encoding="utf-8-sig"
    )
    (tmp_path / "b.csv").write_text("amount,txn_id,category,year,month\n7.0,y,,2024,1\n", encoding="utf-8-sig")
    first = read_processed(spark, str(tmp_path / "a.csv")).orderBy("month").collect()
    assert [tuple(row) for row in first] == [
        ("10", "2025", "my kebab", "1.0", "☠ Self Destruction", "Shouldn't Have"),
        ("9", "2025", "FOOD", "5.0", "🥦 Food", "Essential"),
    ]
    assert tuple(read_processed(spark, str(tmp_path / "b.csv")).first())[:4] == ("1", "2024", "", "7.0")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        read_processed(spark, str(tmp_path / "c.csv"))


@pytest.mark.parametrize("width", [8, 10])
def test_every_file_has_as_many_columns(spark, tmp_path, width):
    (tmp_path / "a.csv").write_text(HEADER + bank_line("one"))
    (tmp_path / "b.csv").write_text("\n" + ",".join(f"c{n}" for n in range(width)) + "\n" + ",".join(["x"] * width) + "\n")
    with pytest.raises(ValueError, match=f"number of columns: .*{width} in .*b.csv"):
        read_bank_csv(spark, str(tmp_path))


def test_headers_of_other_names_are_read_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + bank_line("one"))
    (tmp_path / "b.csv").write_text("\ufeff" + HEADER.upper() + bank_line("two"), encoding="utf-8")
    (tmp_path / "c.csv").write_text(HEADER + bank_line("three"))
    (tmp_path / "d.csv").write_text("\n  \n")
    assert texts(read_bank_csv(spark, str(tmp_path)).rows) == ["one", "two", "three"]
    headers = {row.file[-5:]: row.header for row in probe_files(spark, str(tmp_path)).collect()}
    assert headers["a.csv"] == headers["c.csv"] != headers["b.csv"] and headers["d.csv"] is None


def test_headers_are_found_in_splits(spark, tmp_path):
    for number in range(5):
        (tmp_path / f"{number}.csv").write_text("\n" * number + f"head{number % 2},b\n" + "line,2\n" * 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split_bytes in ("40", "200", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        try:
            groups = files_by(header_census(spark, str(tmp_path)), "header")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted([name[-5] for name in names] for names in groups.values()) == [["0", "2", "4"], ["1", "3"]]


def test_processed_files_in_two_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("month,year,category,amount\n1,2024,FUEL,5.0\n")
    (tmp_path / "b.csv").write_text("\ufeffamount,category,x,year,month\n7.0,FUEL,?,2024,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    found = read_processed(spark, str(tmp_path)).orderBy("month").collect()
    assert [tuple(row)[:4] for row in found] == [("1", "2024", "FUEL", "5.0"), ("2", "2024", "FUEL", "7.0")]
    (tmp_path / "d.csv").write_text("amount,category,year\n7.0,FUEL,2024\n")
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        read_processed(spark, str(tmp_path))
