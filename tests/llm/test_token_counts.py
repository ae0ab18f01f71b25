from __future__ import annotations

import random

import public_tokenizers
import pytest

from ledgerloom.llm.token_counts import PieceCounter, count_tokens
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    draw = random.Random(5)
    mixed = "".join(draw.choice("ab▁ \n漢́😀éx\t") for _ in range(6000))
    prose = " ".join("".join(draw.choice(["the", "on", "er", "ï", "ß."]) for _ in range(3)) for _ in range(900))
    return ["", " ", "short text", "a" * 5000, "漢字かな" * 700 + "x" * 900 + " " * 900 + "é漢 " * 500, mixed, prose, "</s><s> <0x0A> " * 200, "x\0y " * 800]


@pytest.mark.parametrize("chunk, overlap", [(300, 8), (1000, 64), (32_768, 512)])
def test_splices_equal_the_whole(chunk, overlap):
    counter = PieceCounter(MODEL, chunk, overlap)
    assert counter.counts(texts()) == [len(ids) for ids in counter.model.encode(texts())]
    assert counter.widened > 0 or chunk > 6000


def test_rows(spark):
    rows = [(number, text) for number, text in enumerate(texts())] + [(None, "a b"), (3, None), (3, None)]
    df = brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    model = PieceCounter(MODEL).model
    wanted = [
        (key, len((text or "").encode()), size := len(model.encode(text or "")), size > 1000) for key, text in rows
    ]
    found = [tuple(row) for row in count_tokens(df, limit=1000, chunk=500, overlap=16).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert count_tokens(df.limit(0)).collect() == []


def test_long_texts_at_the_registered_setting():
    draw = random.Random(6)
    words = lambda count: " ".join("".join(draw.choice(["the", "on", "er", "ï", "ß.", "a"]) for _ in range(3)) for _ in range(count))
    long = [words(30_000), "漢字かな" * 20_000, "a" * 100_000, words(4000) + " " * 70_000 + words(4000)]
    counter = PieceCounter(MODEL)
    assert all(len(text) > 2 * 32_768 for text in long)
    assert counter.counts(long) == [len(ids) for ids in counter.model.encode(long)]
