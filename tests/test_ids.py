from __future__ import annotations

import hashlib
import random
from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerloom.operators import ids
from ledgerloom.operators.merge import first_per_id, merge_import, new_rows
from ledgerloom.operators.normalise import IMPORT_ID, INGEST_ORDER, RAW_COLUMNS, normalise

SCHEMA = "booking_date date, value_date date, txn_type string, amount string, currency string, data string"
JAN = date(2025, 1, 15)
ROW = (JAN, JAN, "zakup w terminalu", "-50.00", "PLN", "biedronka")

# Ids of known bank rows (date, type, amount, description, extra, location block).
KNOWN_IDS = {
    ("2025-09-01", "Zakup w terminalu", "-50.00", "Biedronka", "", ""):
        "v1:be892a8409d73dce04eaf86dce5213097d219e6476ce573ad768c920238cab10",
    ("2025-05-03", "Zakup w terminalu", "-15.00", "MPK Łódź", "", ""):
        "v1:2f875041e958e1c687a3c1cbb0d33606d024b8bfaa6e1f47debfd34fedcb1253",
    ("2025-02-07", "Zakup w terminalu", "-25.00", "McDonald's", "", ""):
        "v1:548b502ab3ef258fd986f129a82a7d1feddc7fe7fc3583f9c0de66c24e8faf83",
    ("2025-11-29", "Zakup w terminalu", "-300.00", "65463", "test",
     "tesLokalizacja : Adres : UL. PIOTRKOWSKA 146 Miasto : LODZ Kraj : POLSKA"):
        "v1:d04f7b9f0eb51f64643577600397c561f897532c51b9a6e5217853a3d3cd454d",
    ("2025-04-12", "Zakup w terminalu", "-120.00", "Smyk", "",
     "Smyk - Lokalizacja : Adres : ul. Źródlana : Warszawa Kraj : POLSKA"):
        "v1:ce6322a9786bb2a53c7b8918dc49b51b9f46a12a2dd9f90ad4c72388648851bc",
    ("2025-01-31", "Przelew na rachunek", "5200.00", "Wynagrodzenie za styczeń", "", ""):
        "v1:f18e6b8c064acfded74af07de68456b9355d6ee0d59ce03489d1d44fb84a0f0c",
    ("2025-05-20", "Przelew na rachunek", "300.00", "Darowizna od rodziców", "", ""):
        "v1:52994874d0c7ebe5224c680170e56163b758938a94f9cb7e856c8c4d8368b4b3",
}


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def assigned(spark, rows, schema=SCHEMA, **options):
    return ids.assign_txn_ids(frame(spark, rows, schema), **options).collect()


def test_hash_layout(spark):
    payload = "2025-09-01|2025-09-01|-5000|PLN|ZAKUP W TERMINALU|zakup w terminalu//biedronka|0"
    day = F.lit("2025-09-01")
    column = ids.txn_id(
        day, day, F.lit(-5000), F.lit(" pln "), F.lit("zakup w terminalu"),
        F.lit("  Zakup w\tterminalu//Biedronka "), F.lit(0),
    )
    value = spark.range(1).select(column.alias("id")).first().id
    assert value == "v1:" + hashlib.sha256(payload.encode()).hexdigest()
    assert value == "v1:be892a8409d73dce04eaf86dce5213097d219e6476ce573ad768c920238cab10"
    assert len(value) == ids.TXN_ID_LENGTH


def test_ids_of_known_bank_rows(spark):
    rows = [
        (day, day, kind, amount, "PLN", text, extra or None, place or None, None)
        for day, kind, amount, text, extra, place in KNOWN_IDS
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in RAW_COLUMNS))
    assert {row.txn_id for row in ids.assign_txn_ids(normalise(raw)).collect()} == set(KNOWN_IDS.values())


def test_id_is_first_column_and_rows_are_kept(spark):
    result = ids.assign_txn_ids(frame(spark, [ROW]))
    assert result.columns == ["txn_id", "booking_date", "value_date", "txn_type", "amount", "currency", "data"]
    assert tuple(result.first())[1:] == ROW


def test_equal_rows_get_distinct_ids_whatever_the_order(spark):
    other = (*ROW[:5], "orlen")
    seen = Observation("repeated")
    rows = assigned(spark, [ROW, ROW, other, ROW], collisions=seen)
    assert len({row.txn_id for row in rows}) == 4
    assert seen.get == {"repeated_rows": 2}
    assert {row.txn_id for row in assigned(spark, [other, ROW, ROW, ROW])} == {row.txn_id for row in rows}


def test_whitespace_case_and_amount_spelling_do_not_matter(spark):
    messy = (JAN, JAN, " Zakup W terminalu ", "-50,000", " pln", "  Biedronka ")
    assert assigned(spark, [ROW])[0].txn_id == assigned(spark, [messy])[0].txn_id
    assert assigned(spark, [ROW])[0].txn_id != assigned(spark, [(*ROW[:3], "-50.01", *ROW[4:])])[0].txn_id


def test_column_types_do_not_matter(spark):
    schema = "booking_date string, value_date timestamp, txn_type string, amount double, currency string, data string"
    typed = frame(spark, [("2025-01-15", None, "zakup w terminalu", -50.0, "PLN", "biedronka")], schema)
    dated = typed.withColumn("value_date", F.to_timestamp(F.lit("2025-01-15 10:00:00")))
    assert ids.assign_txn_ids(dated).first().txn_id == assigned(spark, [ROW])[0].txn_id


@pytest.mark.parametrize(
    "dropped, default", [("value_date", None), ("currency", "PLN"), ("txn_type", None)], ids=lambda value: str(value)
)
def test_optional_columns_have_defaults(spark, dropped, default):
    full = frame(spark, [ROW])
    explicit = full.withColumn(dropped, F.lit(default).cast(full.schema[dropped].dataType))
    assert ids.assign_txn_ids(full.drop(dropped)).first().txn_id == ids.assign_txn_ids(explicit).first().txn_id


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"missing required columns \['amount', 'booking_date'\]"):
        ids.assign_txn_ids(spark.createDataFrame([("x",)], "data string"))


def test_missing_amount_fails(spark):
    with pytest.raises((PySparkException, Py4JJavaError), match="amount is missing"):
        assigned(spark, [(*ROW[:3], None, *ROW[4:])])


def test_iso_dates(spark):
    values = ["2025-01-15", "", None, "not-a-date", "2025-01-15 10:11:12"]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, d string")
    found = rows.select("n", ids.iso_date(F.col("d")).alias("d")).orderBy("n").collect()
    assert [row.d for row in found] == ["2025-01-15", "", "", "", "2025-01-15"]


def ordered(spark, count, hot_share, seed=7):
    generator = random.Random(seed)
    rows = []
    for order in generator.sample(range(count * 3), count):
        text = "fee" if generator.random() < hot_share else f"shop {generator.randint(1, 40)}"
        rows.append((JAN, "-5.00", text, order, f"file{generator.randint(0, 1)}"))
    return rows, f"booking_date date, amount string, data string, {INGEST_ORDER} long, {IMPORT_ID} string"


@pytest.mark.parametrize("hot_rows, slice_bits", [(10**6, 20), (50, 3), (50, 6), (0, 2)])
def test_sliced_counting_equals_running_count(spark, hot_rows, slice_bits):
    rows, schema = ordered(spark, 1500, 0.4)
    expected, seen = {}, {}
    for _, _, text, order, source in sorted(rows, key=lambda row: row[3]):
        expected[source, order] = seen.get((source, text), 0)
        seen[source, text] = expected[source, order] + 1
    counted = ids.with_occurrence(frame(spark, rows, schema).repartition(5), hot_rows, slice_bits).collect()
    assert {(row[IMPORT_ID], row[INGEST_ORDER]): row.occurrence for row in counted} == expected


def test_slices_bound_the_window_groups(spark):
    rows, schema = ordered(spark, 2000, 0.6)
    keyed = ids.keyed(frame(spark, rows, schema))
    hot = ids.hot_crowds(keyed, 100).collect()
    fee = keyed.where("data = 'fee'").select("_crowd").distinct().collect()
    assert {row._hot for row in hot} >= {row._crowd for row in fee}
    crowds = {row._crowd: row["count"] for row in keyed.groupBy("_crowd").count().collect()}
    assert {row._hot for row in hot} == {crowd for crowd, count in crowds.items() if count > 100}


def test_overlapping_imports_share_ids(spark):
    rows = [(*ROW[:5], text) for text in ("biedronka", "orlen", "netflix", "amazon")]
    first = {row.txn_id for row in assigned(spark, rows[:3])}
    second = {row.txn_id for row in assigned(spark, rows)}
    assert first < second
    assert len(second - first) == 1


def test_merge_adds_only_new_rows(spark):
    rows = [(*ROW[:5], text) for text in ("biedronka", "orlen", "netflix", "amazon")]
    ledger = ids.assign_txn_ids(frame(spark, rows[:3] + rows[:1]))
    imported = ids.assign_txn_ids(frame(spark, rows + rows[:1]))
    assert [row.data for row in new_rows(imported, ledger).collect()] == ["amazon"]
    merged = merge_import(ledger, imported)
    assert merged.count() == merged.select("txn_id").distinct().count() == 5


def test_first_per_id_takes_the_earliest_copy(spark):
    schema = f"txn_id string, data string, {IMPORT_ID} string, {INGEST_ORDER} long"
    rows = [("a", "late", "f2", 1), ("a", "early", "f1", 9), ("a", "earliest", "f1", 2), ("b", "only", "f2", 5)]
    picked = first_per_id(frame(spark, rows, schema))
    assert picked.columns == ["txn_id", "data", IMPORT_ID, INGEST_ORDER]
    assert sorted(row.data for row in picked.collect()) == ["earliest", "only"]
