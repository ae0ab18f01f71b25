from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import languages
from ledgerloom.llm.languages import Model, bags, identify, learn
from tests.llm import brute

FOLDER = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string"


def plain_trigrams(text):
    text = text.lower()
    word = lambda at: text[at] if 0 <= at < len(text) and text[at].isalpha() else " "
    return Counter(word(at - 1) + word(at) + word(at + 1) for at in range(len(text)) if text[at].isalpha())


def plain_mixture(counts, likely, languages, rounds=400):
    """Shares by expectation-maximisation, one trigram at a time."""
    shares = dict.fromkeys(languages, 1 / len(languages))
    for _ in range(rounds):
        held = dict.fromkeys(languages, 0.0)
        for gram, count in counts.items():
            parts = {name: shares[name] * likely[gram][name] for name in languages}
            for name in languages:
                held[name] += count * parts[name] / sum(parts.values())
        shares = {name: held[name] / sum(held.values()) for name in languages}
    value = sum(count * math.log(sum(shares[name] * likely[gram][name] for name in languages)) for gram, count in counts.items())
    return shares, value


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = identify(brute.with_clashing(docs))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]
    rows = found.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2 and 0 <= row["score"] <= 1 for row in rows)
    judged = [row for row in rows if row["lang"] is not None and row["lang_pred"] != "und"]
    assert len(judged) > 0.9 * len(rows)
    assert sum(row["lang"] == row["lang_pred"] for row in judged) / len(judged) >= 0.97


def test_mixed_texts_show_their_shares(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = learn(docs)
    texts = {row["lang"]: row["text"] for row in docs.where("n_chars between 1500 and 4000").collect()}
    mixed = [texts["de"][:600] + "\n" + texts["es"][:200], texts["fr"][:300] + " " + texts["en"][:300], texts["en"][:900]]
    shares = model.mixtures(bags(mixed)).shares
    by_name = [dict(zip(model.languages, row)) for row in shares]
    assert [sum(row > 0) for row in shares] == [2, 2, 1]
    assert abs(by_name[0]["de"] - 0.75) < 0.1 and abs(by_name[0]["es"] - 0.25) < 0.1
    assert abs(by_name[1]["fr"] - 0.5) < 0.1 and by_name[2]["en"] == 1


def test_held_out_languages_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 300")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(identify(docs)) == as_rows(identify(changed))


def test_odd_rows(spark):
    rows = [(key, "the cat sat on the mat with that hat", "en") for key in range(20)]
    rows += [(key, "der Hund schläft nicht auf dem Dach und", "de") for key in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "en"), (52, " 12, 34! ", "de"), (53, "́ ́", "de"), (54, "漢字", None), (None, "the hat", None)]
    rows += [(55, "the cat " * 300_000, None), (55, "der Hund " * 1000, "en"), (56, "x", None)]
    df = spark.createDataFrame(rows, SHAPE)
    found = identify(brute.with_clashing(df)).collect()
    assert len(found) == len(rows)
    named = {}
    for row in found:
        named.setdefault(row["doc_id"], set()).add(row["lang_pred"])
        assert 0 <= row["score"] <= 1 and math.isclose(sum(row["shares"]), 1 if row["languages"] else 0, abs_tol=1e-9)
    assert all(named[key] == {"und"} for key in (50, 51, 52, 53))
    assert named[None] == {"en"} and named[54] <= {"de", "en"} and named[56] <= {"de", "en"} and len(named[54]) == 1
    assert named[0] == {"en"} and named[30] == {"de"}
    assert identify(df.limit(0)).collect() == []
    assert {(row["lang_pred"], row["score"]) for row in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("chunk", [5, 1 << 21])
def test_trigrams_against_plain(monkeypatch, chunk):
    monkeypatch.setattr(languages, "_CHUNK", chunk)
    texts = ["The cat, the CAT.", "", "a", " éß-x 12 ", "123", "aaaa aaaa"]
    bag = bags(texts)
    for number, text in enumerate(texts):
        own = bag.text == number
        assert sorted(bag.count[own].tolist()) == sorted(plain_trigrams(text).values())
        assert bag.lettered[number] == any(char.isalpha() for char in text)


def test_mixtures_against_plain(monkeypatch):
    monkeypatch.setattr(languages, "ROUNDS", 400)
    draw = np.random.default_rng(4)
    names = ["aa", "bb", "cc"]
    ratios = draw.gamma(0.5, size=(1 << languages.TABLE_BITS, 3)).astype(np.float32) + np.float32(0.05)
    texts = ["lorem ipsum dolor sit amet " * 8, "consectetur adipiscing elit sed do eiusmod", "tempor", "incididunt ut labore " * 40]
    bag = bags(texts)
    found = Model(names, ratios).mixtures(bag)
    for number in range(len(texts)):
        own = bag.text == number
        counts = dict(zip(bag.place[own].tolist(), bag.count[own].tolist()))
        likely = {place: dict(zip(names, map(float, ratios[place]))) for place in counts}
        full, most = plain_mixture(counts, likely, names)
        penalty = languages.PENALTY * math.log(sum(counts.values()) + 1)
        order = sorted(names, key=lambda name: -full[name])
        options = [(plain_mixture(counts, likely, [name], 1)[1], {name: 1.0}) for name in names]
        for members in (2, 3):
            shares, value = plain_mixture(counts, likely, order[:members])
            options.append((value - (members - 1) * penalty, shares))
        wanted = max(options, key=lambda option: option[0])[1]
        assert np.allclose(found.shares[number], [wanted.get(name, 0.0) for name in names], atol=1e-3)
