from __future__ import annotations

import random

from ledgerloom.llm.decontaminate import contamination, without_contaminated, without_windows
from ledgerloom.llm.queries import CORPUS_QUERIES, CORPUS_SQL
from tests.compare import differences, oracle
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def tables(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["the", "Of", "größe", "a1", "漢字", "x", "É"])
    items = [(number, " ".join(word() for _ in range(size))) for number, size in enumerate([12, 15, 3, 1, 9, 10, 40])]
    items += [(None, "only null knows this"), (9, None), (10, ""), (11, " .,! "), (0, items[0][1]), (12, items[1][1])]
    rows = [(number, " ".join(word() for _ in range(draw.randint(0, 60)))) for number in range(60)]
    for number, (_, text) in enumerate(items):
        rows.append((100 + number, f"zz, {text or ''}! zz " + " ".join(word() for _ in range(5)) + f"\n{text or ''}"))
    rows += [(None, items[0][1]), (5, None), (5, items[0][1].upper()), (6, ""), (7, "zz " * 30_000 + items[1][1])]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = tables(spark)
    docs = brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = brute.with_clashing(spark.createDataFrame(items, "item_id long, text string"))
    wanted = sorted(brute.contamination(rows, items), key=repr)
    for entries in (5_000_000, 40):
        found = contamination(docs, bench, broadcast_entries=entries)
        assert sorted((tuple(row) for row in found.collect()), key=repr) == wanted


def test_equals_sql(spark):
    name = "op2_decontamination"
    rows, found = differences(CORPUS_QUERIES[name](spark, FOLDER), oracle(FOLDER), CORPUS_SQL[name])
    assert rows > 0 and not found


def test_only_native_operations(spark):
    plan = contamination(spark.range(3).selectExpr("id AS doc_id", "'a b' AS text"), spark.range(2).selectExpr("id AS item_id", "'a' AS text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow")) and "BroadcastHashJoin" in text


def test_empty_tables(spark):
    rows, items = tables(spark)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(docs.limit(0), bench).collect() == []
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(row["contaminated"] for row in none)


def test_documents_go(spark):
    rows, items = tables(spark)
    docs = spark.createDataFrame([(*row, "src") for row in rows], "doc_id long, text string, id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = without_contaminated(docs, bench)
    wanted = [row for row, judged in zip(rows, brute.contamination(rows, items)) if not judged[-1]]
    assert kept.columns == docs.columns
    assert sorted((tuple(row)[:2] for row in kept.collect()), key=repr) == sorted(wanted, key=repr)


def test_words_go(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item")]
    body = "one TWO three, four five\nsix seven; eight nine ten"
    rows = [
        (1, f"(Before) {body}! after.", "a"),
        (2, f"{body} eleven", "b"),
        (3, "a short, item... and a short item", "c"),
        (4, "nothing here", "d"),
        (None, None, "e"),
        (5, f"é {body} ß {body}", "f"),
        (5, f"é {body} ß {body}", "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = without_windows(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == docs.columns
    wanted = {"a": "(Before) after.", "b": "", "c": "a and a ", "d": "nothing here", "e": None, "f": "é ß ", "g": "é ß "}
    assert {row["spans"]: row["text"] for row in found.collect()} == wanted
    again = contamination(found, spark.createDataFrame(items, "item_id long, text string"), with_hits=True)
    assert all(row["hits"] == [] and row["items"] == [] for row in again.collect())
