"""Generous time limits on sizes and texts that once were a risk."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.classify import clean_descriptions
from ledgerloom.operators.tracks import expense_track, label_tracks
from ledgerloom.sources.bank_csv import read_bank_csv

SCHEMA = "data string, amount string, day int, month int, year int"


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def generated(spark, count):
    text = F.when(F.col("id") % 2 == 0, "purchase in terminal - mobile code orlen").otherwise("transfer to account mcd")
    return spark.range(count).select(
        text.alias("data"), F.lit("-12.50").alias("amount"), *[F.lit(1).alias(name) for name in ("day", "month", "year")]
    )


def test_cost_per_row_does_not_grow(spark):
    noop(label_tracks(generated(spark, 1000)))
    small, large = (seconds(lambda size=size: noop(label_tracks(generated(spark, size)))) for size in (5_000, 50_000))
    assert large / 50_000 <= 10 * small / 5_000
    assert seconds(lambda: noop(clean_descriptions(generated(spark, 10_000)))) < 30


@pytest.mark.parametrize("text", ["x" * 1_000_000, "(" * 1002 + ")" * 1002, "zwro" * 250_000, "a // " * 100_000])
def test_one_huge_cell(spark, text):
    rows = spark.createDataFrame([(text, "-1", 1, 1, 2025)], SCHEMA)
    assert seconds(lambda: expense_track(rows).collect()) < 5


def test_reading_many_rows(spark, tmp_path):
    lines = "".join(f"text {number},-{number}.0,1,2023\n" for number in range(100_000))
    (tmp_path / "a.csv").write_text("data,amount,month,year\n" + lines)

    def read():
        assert read_bank_csv(spark, str(tmp_path)).rows.count() == 100_000

    assert seconds(read) < 30
