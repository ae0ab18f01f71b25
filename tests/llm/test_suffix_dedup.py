from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from ledgerloom.llm import suffix_dedup
from ledgerloom.llm.suffix_dedup import LENGTH, _triggers, remove_repeats, without_repeats
from tests.llm import brute


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())


def made(count=120, seed=4):
    draw = random.Random(seed)
    base = "".join(draw.choice("abc é") for _ in range(3000))
    noise = lambda most: "".join(draw.choice("abcd") for _ in range(draw.randint(0, most)))
    rows = []
    for number in range(count):
        kind, start = draw.random(), draw.randint(0, 2900)
        if kind < 0.2:
            text = "a" * draw.randint(0, 200)
        elif kind < 0.3:
            text = "xy" * draw.randint(0, 100)
        elif kind < 0.6:
            text = noise(60) + base[start : start + draw.randint(10, 120)] + noise(60)
        elif kind < 0.7:
            text = draw.choice([None, "", "x" * 49, "y" * 50])
        else:
            text = base[draw.randint(0, 100) : draw.randint(48, 300)]
        rows.append((draw.randint(0, 60) if number % 7 == 0 else number, text))
    return rows


@pytest.mark.parametrize("sizes", [(300, 500), (1 << 22, 1 << 24)])
def test_equals_brute_force(spark, sizes):
    rows = made()
    df = brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(remove_repeats(df, block_bytes=sizes[0], bucket_bytes=sizes[1])) == brute.repeats(rows)


@pytest.mark.parametrize("limit", [0, 3, 40])
def test_split_triggers_equal_brute_force(spark, limit):
    rows = made(seed=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(remove_repeats(df, block_bytes=300, bucket_bytes=500, entry_limit=limit)) == brute.repeats(rows)


def test_hot_triggers_are_spread_over_buckets(spark):
    # One passage, different text on both sides of it in each document: its triggers near the ends are hot.
    draw = random.Random(8)
    noise = lambda count: "".join(draw.choice("abcdefgh") for _ in range(count))
    passage, buckets = noise(200), 8
    rows = [(number, noise(60) + passage + noise(60)) for number in range(400)]
    blocks = [pa.table({"id": [key for key, _ in rows[at::4]], "text": [text for _, text in rows[at::4]], "block": pa.array([at] * 100, pa.int32())}) for at in range(4)]
    listed = pa.concat_tables([suffix_dedup._list_triggers(block, buckets) for block in blocks])
    of = lambda table, name, value: table.filter(pa.compute.equal(table.column(name), value)).combine_chunks()
    groups = lambda table: [own for bucket in range(buckets) if (own := of(table, "bucket", bucket)).num_rows]
    shared = pa.concat_tables([suffix_dedup._shared_triggers(own, 50) for own in groups(listed)])
    sent = pa.concat_tables([suffix_dedup._send_surroundings(block, of(shared, "block", at), buckets) for at, block in enumerate(blocks)])
    size = lambda own, names: sum(len(suffix_dedup.zstandard.decompress(data)) for name in names for data in own.column(name).to_pylist())
    assert max(size(own, ["sides"]) for own in groups(sent)) < 50 * 80
    loads = [size(own, ["strings"]) for own in groups(sent)]
    assert len(loads) == buckets and max(loads) < 2 * sum(loads) / buckets
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(remove_repeats(df, block_bytes=30_000, bucket_bytes=16_000, entry_limit=50)) == brute.repeats(rows)


def test_every_49_bytes_hold_a_trigger():
    draw = np.random.default_rng(1)
    for text in (draw.integers(0, 256, 5000), draw.integers(0, 2, 5000), np.zeros(500), np.arange(3000) % 7):
        places = _triggers(text.astype(np.uint8))
        gaps = np.diff(np.concatenate(([-1], places, [len(text) - 27])))
        assert gaps.max() <= 22


def test_one_long_text_and_many_copies(spark):
    draw = random.Random(2)
    long = "".join(draw.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long)] + [(number, long[5000:5400]) for number in range(2, 40)]
    found = {row["doc_id"]: row for row in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=9000).collect()}
    assert found[1]["n_removed"] == 0
    assert all(found[number]["n_removed"] == 400 and found[number]["n_spans"] == 1 for number in range(2, 40))


def test_null_ids_and_empty_table(spark):
    text = "x" * 20 + "".join(chr(97 + number % 26) for number in range(60))
    df = spark.createDataFrame([(None, text), (7, text), (None, text)], "doc_id long, text string")
    assert sorted(row["n_removed"] for row in remove_repeats(df).collect()) == [0, 80, 80]
    assert remove_repeats(df.limit(0)).collect() == []


def test_texts_keep_whole_characters_and_columns(spark):
    shared = "".join(chr(97 + number * 7 % 26) for number in range(LENGTH))
    # The string of 50 bytes begins in the middle of the two-byte character.
    first, second = "é" + shared[:49] + "1", "è" + "x" + shared[:49] + "é"
    rows = [(1, first, "a", 51), (2, "ñ" + second, "b", 53), (3, first, "c", 51)]
    df = spark.createDataFrame(rows, "doc_id int, text string, block string, n_chars long")
    result = without_repeats(df)
    assert result.columns == df.columns and result.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    texts = {row["doc_id"]: row for row in result.collect()}
    assert texts[1]["text"] == first and texts[3]["text"] == "" and texts[3]["n_chars"] == 0
    assert texts[2]["block"] == "b" and texts[2]["text"].encode().decode() == texts[2]["text"]


def test_rows_between_blocks_and_buckets_stay_few():
    for size in (10**6, 10**9, 10**11, 10**13):
        larger = suffix_dedup.growth(size, suffix_dedup.BLOCK_BYTES, suffix_dedup.BUCKET_BYTES)
        pairs = size / (suffix_dedup.BLOCK_BYTES * larger) * (size / (suffix_dedup.BUCKET_BYTES * larger))
        assert 1 <= larger <= suffix_dedup.MOST_GROWTH and pairs * 100 <= size / 5
    assert suffix_dedup.growth(10**9, 4 << 20, 8 << 20) == 1


def test_tasks_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 1000)
    df = spark.createDataFrame([(number, "word " * 100) for number in range(40)], "doc_id long, text string")
    text = remove_repeats(df, block_bytes=500, bucket_bytes=500)._jdf.queryExecution().executedPlan().toString()
    assert text.count(", 20), REPARTITION_BY_NUM") >= 5 and "ENSURE_REQUIREMENTS" not in text


def test_repeats_of_odd_tables_are_cut(spark):
    text = "".join(chr(97 + number * 11 % 26) for number in range(70))
    df = spark.createDataFrame([(None, text), (3, text), (None, None), (3, text)], "doc_id long, text string")
    found = without_repeats(brute.with_clashing(df))
    assert sorted((row["doc_id"] or -1, row["text"]) for row in found.collect()) == [(-1, ""), (-1, ""), (3, text), (3, text)]
    empty = without_repeats(brute.with_clashing(df.limit(0)))
    assert empty.collect() == [] and empty.columns == brute.with_clashing(df).columns
