"""Cached words, packing and token files against the tokenizer library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.packing import TierPacker, pack_documents, step_groups
from ledgerloom.llm.token_files import Segment, pack, read_tokens, token_digest, write_tokens
from ledgerloom.llm.tokens import WordEncoder
from tests.llm import brute

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "\n\n", "  a  b ", "don't can't 'tis ''s x's", "a<|endoftext|> b <|startoftext|>", "ÀÉÿß ÇÜ ×÷", "１２ ²³ ٣",
    "\t\ta\t b\n \nc ", "İSTANBUL ΣΑΣ ﬁ é ́x", "漢字 かな", "a b\x1cc\x85d", "%%% *** a!!! B.C 3.14 100,000 'll'd",
]


def library(name, texts, end):
    encoder = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*encoded.ids, end], "<u4") for encoded in encoder.encode_batch(texts, add_special_tokens=False)]


def table(spark, long=30_000):
    draw = random.Random(6)
    prose = lambda count: " ".join(draw.choice(["Alpha", "beta", "of", "the", "gamma.", "d'or", "é"]) for _ in range(count))
    rows = [(number, text) for number, text in enumerate(TEXTS)]
    rows += [(100 + number, prose(draw.randint(1, 900))) for number in range(150)] + [(50, prose(long))]
    rows += [(None, "x y"), (None, None), (3, None), (3, "again"), (3, "again")]
    draw.shuffle(rows)
    return rows, brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


@pytest.mark.parametrize("name", FILES)
def test_words_equal_the_library(name):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("ab '\n\t.9Éé漢") for _ in range(300)) for _ in range(20)]
    texts += ["".join(draw.choice("ab '\n\t.9Éé") for _ in range(300)) for _ in range(20)]
    encoder = WordEncoder(public_tokenizers.path(name), cached_words=50)
    assert encoder.kind
    for _ in range(2):
        found = encoder.encode(texts)
        assert [ids.tolist() for ids in found] == [ids.tolist()[:-1] for ids in library(name, texts, 0)]


def test_segments_round_trip():
    draw = np.random.default_rng(1)
    lists = [
        np.zeros(0), np.array([7]), draw.integers(0, 50257, 1000), np.full(300, 2**32 - 1), draw.integers(0, 2**32, 777),
        np.r_[draw.integers(0, 10, 5000), [2**32 - 1, 2**31]], np.arange(100_000) % 50257,
    ]
    for ids in lists:
        ids = ids.astype(np.uint32)
        segment = Segment(pack(ids))
        assert np.array_equal(segment.ids(), ids)
        for _ in range(10):
            start, stop = sorted(draw.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(segment.ids(start, stop), ids[start:stop])
    # Outliers are exceptions and do not widen their blocks.
    assert len(pack(np.r_[np.arange(1000) % 8, 40_000].astype(np.uint32))) < 1000


@pytest.mark.parametrize("segment", [64, 1 << 18])
def test_token_files(spark, segment):
    rows, df = table(spark)
    ordered = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or ""))
    wanted, start = [], 0
    for (key, _), ids in zip(ordered, library("byte_bpe_50k.json", [text or "" for _, text in ordered], 2)):
        wanted.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = [tuple(row) for row in token_digest(df, segment_ids=segment).collect()]
    assert sorted(found, key=lambda row: row[1]) == wanted


def test_empty_token_files(spark, tmp_path):
    _, df = table(spark)
    write_tokens(df.limit(0), str(tmp_path / "files"))
    assert read_tokens(spark, str(tmp_path / "files")).collect() == []
    assert pack_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("pool", [5, 4096])
def test_every_id_in_one_piece(spark, pool):
    rows, df = table(spark)
    found = pack_documents(df, pool=pool).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for row in found:
        sequences[row["sequence_id"]].append(row)
        pieces[row["doc_id"], row["doc_tokens"]].append(row)
    for own in sequences.values():
        offset = 0
        for row in sorted(own, key=lambda row: row["offset"]):
            assert row["offset"] == offset and row["length"] > 0
            offset += row["length"]
        assert offset <= 2048 and offset & (offset - 1) == 0 and {row["tier"] for row in own} == {offset}
    sums = defaultdict(list)
    for (key, text), ids in zip(rows, library("word_bpe_49k.json", [text or "" for _, text in rows], 1)):
        sums[key, len(ids)].append(ids)
    assert sums.keys() == pieces.keys()
    for key, lists in sums.items():
        # Rows with the same id and length are told apart by what they hold.
        counts = sorted((row["start"], row["length"], row["ids_crc32"]) for row in pieces[key])
        assert sum(length for _, length, _ in counts) == sum(map(len, lists))
        possible = {zlib.crc32(ids[start : start + length].tobytes()) for ids in lists for start, length, _ in counts}
        assert all(crc in possible for _, _, crc in counts)
        if len(lists) == 1:
            place = 0
            for start, length, crc in counts:
                assert start == place and crc == zlib.crc32(lists[0][start : start + length].tobytes())
                place += length


def test_tiers_and_step_groups():
    packer = TierPacker(longest=2048, shortest=256)
    windows = [window for number, count in enumerate([5000, 300, 900, 40, 1500, 2048, 700, 260]) for window in packer.add(number, count)]
    windows += packer.pack(last=True)
    sizes = [sum(piece[0] for piece in window) for window in windows]
    assert sum(sizes) == 10_748 and all(size & (size - 1) == 0 for size in sizes)
    assert set(sizes) & {512, 1024}
    groups = step_groups(sizes * 20, 16_384)
    loads = [sum(size for size, group in zip(sizes * 20, groups) if group == number) for number in set(groups)]
    assert max(loads) - min(loads) <= 2048
