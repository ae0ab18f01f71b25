from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm.common import checkpointed, table
from ledgerloom.llm.queries import CORPUS_QUERIES, CORPUS_SQL
from ledgerloom.llm.toxicity import without_toxic
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(row["doc_id"], row["text"]) for row in docs.collect()]
        docs = checkpointed(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = before, [(row["doc_id"], row["text"]) for row in docs.collect()]
    before, after = seen["near-duplicates"]
    marks = [brute.fingerprint(text) for _, text in before]
    group = brute.groups(marks, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {name: min(before[at][0] for at, own in enumerate(group) if own == name) for name in group}
    assert sorted(key for key, _ in after) == sorted(least.values())
    before, after = seen["repeated-strings"]
    left = {row[0]: row[1] - row[2] for row in brute.repeats(before)}
    assert len(before) == len(after) and all(len(text.encode()) <= left[key] for key, text in after)
    assert all(text == dict(before)[key] for key, text in after if left[key] == len(dict(before)[key].encode()))
    before, after = seen["decontamination"]
    items = [(row["item_id"], row["text"]) for row in table(spark, FOLDER, "benchmark").collect()]
    judged = brute.contamination(before, items)
    assert Counter(after) == Counter(row for row, verdict in zip(before, judged) if not verdict[-1])
    packed = docs.collect()
    assert {row["doc_id"] for row in packed} == {key for key, _ in after}
    # Each document's ids, piece after piece, are those the library gives.
    pieces = defaultdict(list)
    for row in packed:
        pieces[row["doc_id"]].append((row["start"], row["length"], row["ids_crc32"]))
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for key, text in after:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[key])
        assert [start for start, _, _ in own] == [0, *np.cumsum([length for _, length, _ in own])[:-1].tolist()]
        assert [crc for _, _, crc in own] == [zlib.crc32(ids[start : start + length].tobytes()) for start, length, _ in own]
        assert sum(length for _, length, _ in own) == len(ids)


def odd_documents(spark):
    text = "".join(chr(97 + number * 11 % 26) for number in range(70)) + " and some more words to read here"
    rows = [(None, text), (3, text), (None, None), (3, text), (4, ""), (5, "x " * 100_000), (6, "漢字 é")]
    return brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    docs = odd_documents(spark)
    found = stage(spark, docs, FOLDER)
    assert found.count() > 0 and (name == "packing" or found.columns == docs.columns)
    assert stage(spark, docs.limit(0), FOLDER).collect() == []


def test_toxicity_needs_both_classes(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    for known in (labels.where("toxic = 0"), labels.limit(0)):
        assert without_toxic(docs, known).count() == docs.count()


def test_run_and_registry(spark):
    import __spark_entry__ as contract

    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert contract.queries().keys() >= {"pipeline", *CORPUS_QUERIES} and contract.oracle_sql().keys() >= CORPUS_SQL.keys()
    assert sorted(int(name[2:].split("_")[0]) for name in CORPUS_QUERIES) == list(range(1, 14))
