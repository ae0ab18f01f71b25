from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.ids import assign_txn_ids
from ledgerloom.operators.normalise import normalise
from ledgerloom.operators.tracks import label_tracks
from ledgerloom.sources.bank_csv import read_bank_csv
from ledgerloom.streaming import drop_folder
from ledgerloom.streaming.drop_folder import fold_import, import_files, read_ledger
from tests.test_sources import HEADER, bank_line


def drop(folder, name, *texts, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes((HEADER + "".join(bank_line(text) for text in texts)).encode(encoding))


def run(spark, tmp_path, **options):
    stream = import_files(
        spark, str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), **options
    )
    stream.awaitTermination()
    return spark.read.parquet(str(tmp_path / "ledger"))


def test_overlapping_files_are_merged(spark, tmp_path):
    drop(tmp_path / "in", "a.csv", "Biedronka", "Żabka", "Żabka", encoding="cp1250")
    drop(tmp_path / "in", "b.csv", "Biedronka", "Żabka", "Orlen")
    first = run(spark, tmp_path, files_per_batch=1)
    assert sorted(row.data for row in first.collect()) == [
        "zakup//Orlen gas station",
        "zakup//biedronka",
        "zakup//żabka",
        "zakup//żabka",
    ]
    drop(tmp_path / "in", "c.csv", "Żabka", "Żabka", "Żabka", "Netflix")
    second = run(spark, tmp_path)
    assert second.count() == second.select("txn_id").distinct().count() == 6
    # Nothing new: nothing happens.
    assert run(spark, tmp_path).count() == 6


def test_copies_within_one_batch_count_once(spark, tmp_path):
    drop(tmp_path / "in", "a.csv", "Biedronka", "Orlen")
    drop(tmp_path / "in", "b.csv", "Biedronka", "Orlen")
    assert run(spark, tmp_path).count() == 2


def test_batches_with_very_many_months(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drop_folder, "MOST_MONTHS", 0)
    drop(tmp_path / "in", "a.csv", "Biedronka", "Orlen")
    assert run(spark, tmp_path).count() == 2
    drop(tmp_path / "in", "b.csv", "Biedronka", "Netflix")
    assert run(spark, tmp_path).count() == 3


def test_repeated_batch_replaces_its_own_output(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert read_ledger(spark, ledger) is None
    drop(tmp_path / "in", "a.csv", "Biedronka", "Orlen")
    labelled = label_tracks(assign_txn_ids(normalise(read_bank_csv(spark, str(tmp_path / "in")).rows)))
    for _ in range(2):
        fold_import(labelled, labelled, ledger, "files", 0)
        assert read_ledger(spark, ledger).count() == 2
    fold_import(labelled, labelled, ledger, "files", 1)
    fold_import(labelled.withColumn("txn_id", F.concat("txn_id", F.lit("x"))), labelled, ledger, "other", 0)
    assert read_ledger(spark, ledger).count() == 4


def test_stateless_steps_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("Orlen", "-1", 1, 1, 2025, "id")], "data string, amount string, day int, month int, year int, txn_id string").write.parquet(str(tmp_path / "s"))
    stream = label_tracks(spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s")))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).first().category == "FUEL"
