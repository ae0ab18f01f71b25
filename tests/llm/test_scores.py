"""Quality and toxicity: held-out accuracy, and that held-out rows are never learned from."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.labelled import labelled_sample
from ledgerloom.llm.quality import score_quality
from ledgerloom.llm.toxicity import bags, score_toxicity, train, without_toxic
from tests.llm import brute

FOLDER = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"
CASES = [(score_quality, "quality", 4, 2, 0.97), (score_toxicity, "toxic", 5, 0, 0.9)]


def tables(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("score, label, modulus, held_out, least", CASES)
def test_held_out_accuracy(spark, score, label, modulus, held_out, least):
    docs, labels = tables(spark, FOLDER)
    found = score(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(row["doc_id"]).encode()) % modulus == held_out for row in rows)
    assert all(0 <= row["score"] <= 1 for row in rows)
    assert sum(row["predicted"] == row[label] for row in rows) / len(rows) >= least


@pytest.mark.parametrize("score, label, modulus, held_out, least", CASES)
def test_held_out_labels_change_nothing(spark, score, label, modulus, held_out, least):
    docs, labels = tables(spark, SMALL)
    docs = docs.where("doc_id < 400")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out
    flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    as_rows = lambda df: sorted(tuple(row) for row in df.collect())
    assert as_rows(score(docs, labels)) == as_rows(score(docs, flipped))


@pytest.mark.parametrize("score, label, modulus, held_out, least", CASES)
def test_odd_rows(spark, score, label, modulus, held_out, least):
    docs, labels = tables(spark, SMALL)
    odd = [(None, "text"), (1, None), (1, ""), (1, " "), (2, "\x00 漢 \ud7ff"), (2, "%" * 200_000), (3, "word " * 30_000)]
    rows = docs.where("doc_id < 300").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    marked = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    found = score(brute.with_clashing(rows), brute.with_clashing(marked)).collect()
    assert len(found) == 307 and all(0 <= row["score"] <= 1 for row in found)
    assert score(rows.limit(0), labels).collect() == []
    none = score(rows, labels.limit(0)).collect()
    assert len(none) == 307 and len({row["score"] for row in none}) == 1


def test_dictionaries_are_built_alike():
    texts = [[f"text {number} of {kind} and more of {number * 7} ".encode() * 9 for number in range(count)] for kind, count in (("bad", 60), ("good", 2000))]
    small = quality.dictionaries(texts)
    size = sum(map(len, texts[0])) // 8
    assert [abs(len(own) - size) <= size // 4 for own in small] == [True, True]
    # More bytes to read give larger dictionaries of both classes.
    assert all(len(a) > len(b) for a, b in zip(small, quality.dictionaries(texts, 12_000)))
    assert quality.dictionaries([[b"few"], texts[1]]) is None
    assert quality.train([("a", 0), ("b", 0), ("c", 1), ("d", 1)], 0.5) is None


def test_sizes_and_scores_against_plain(spark):
    docs, labels = tables(spark, FOLDER)
    docs = docs.where("doc_id < 1500").select("doc_id", "text")
    sample = labelled_sample(docs, labels, "quality", 4, 2, 3000, 20_000)
    known = labels.where("quality is not null").collect()
    learned = [row["quality"] for row in known if zlib.crc32(str(row["doc_id"]).encode()) % 4 != 2]
    model = quality.train(sample, sum(learned) / len(learned))
    found = {row["doc_id"]: row for row in score_quality(docs, labels).collect()}
    for row in docs.collect():
        wanted = brute.quality((row["text"] or "").encode(), model.good, model.bad, model.centre, model.spread, model.weights)
        assert abs(found[row["doc_id"]]["score"] - wanted) < 1e-9
        assert found[row["doc_id"]]["predicted"] == int(found[row["doc_id"]]["score"] >= 0.7)


def test_scores_are_maxima_over_windows(spark):
    docs, labels = tables(spark, FOLDER)
    model = train(labelled_sample(docs, labels, "toxic", 5, 0, 300, 6_000))
    texts = ["Some words, some WORDS here.", "", "a b", "ünï cödé word " * 40, "x" * 3000 + " y"]
    texts += [row["text"] for row in docs.where("doc_id < 60").collect()]
    for text, score in zip(texts, model.scores(texts)):
        assert abs(score - brute.toxicity(text, model.weights, model.bias, model.scale, model.shift)) < 1e-6


def test_bags():
    bag = bags(["a Bb bb. BB\ncc", "", " x\x00y ", "é"])
    # A word that repeats the one before it is left out; "bb" follows "a".
    assert bag.window_text.tolist() == [0, 1, 2, 3] and bag.word_window.tolist() == [0, 0, 0, 2, 2, 3]


def test_misspellings_share_vectors():
    clean = [(" ".join(f"word{(number * 7 + at) % 90}" for at in range(60)), 0) for number in range(60)]
    toxic = [(text.replace(f"word{number % 90} ", f"horridly{number % 3} ", 1) + " horridly", 1) for number, (text, _) in enumerate(clean)]
    model = train(clean + toxic)
    scores = model.scores([clean[0][0], clean[0][0] + " horridlyy", clean[0][0] + " horridlyish"])
    assert scores[0] < 0.5 < min(scores[1:])


def test_toxic_documents_go(spark):
    docs, labels = tables(spark, SMALL)
    kept = without_toxic(docs, labels)
    scores = {row["doc_id"]: row["predicted"] for row in score_toxicity(docs, labels).collect()}
    assert kept.schema == docs.schema
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(key for key, toxic in scores.items() if not toxic)
