from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours
from ledgerloom.llm.neighbours import balanced_parts, search
from tests.llm import brute

FOLDER = "/root/testdata/sf0.1"
SHAPE = "vec_id long, embedding array<float>"


def exact(rows, count=10):
    ids = np.array([key for key, _ in rows])
    matrix = np.array([vector for _, vector in rows], np.float32).astype(np.float64)
    wanted = {}
    for key, vector in zip(ids, matrix):
        if key % 100 == 0:
            score = np.sqrt(((matrix - vector) ** 2).sum(1))
            order = [at for at in np.lexsort((ids, score)) if ids[at] != key][:count]
            wanted[int(key)] = [(int(ids[at]), float(score[at])) for at in order]
    return wanted


def by_query(df):
    found = {}
    for row in sorted(df.collect(), key=lambda row: (row["query_id"], row["rank"])):
        own = found.setdefault(row["query_id"], [])
        assert row["rank"] == len(own) + 1
        own.append((row["vec_id"], row["score"]))
    return found


def recall(wanted, found):
    assert wanted.keys() == found.keys() and all(len(own) == 10 for own in found.values())
    hits = [len({key for key, _ in own} & {key for key, _ in found[query]}) for query, own in wanted.items()]
    return sum(hits) / (10 * len(hits))


def watched(monkeypatch):
    """What a search compares: how many pairs of a query and a row, and in how many parts the rows are."""
    seen = {}
    compared = neighbours._compared

    def count(index, asked, dims, wanted):
        sizes = {row["node"]: row["count"] for row in index.groupBy("node").count().collect()}
        seen["parts"], seen["rows"] = len(sizes), sum(sizes.values())
        asks = {row["node"]: row["count"] for row in asked.groupBy("node").count().collect()}
        seen["pairs"] = sum(sizes[node] * many for node, many in asks.items())
        return compared(index, asked, dims, wanted)

    monkeypatch.setattr(neighbours, "_compared", count)
    return seen


@pytest.mark.parametrize("folder, parts", [("/root/testdata/sf0.1", 8), ("/root/testdata/sf0.01", 8)])
def test_recall_against_brute_force(spark, monkeypatch, folder, parts):
    seen = watched(monkeypatch)
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(row) for row in df.collect()]
    wanted, found = exact(rows), by_query(search(brute.with_clashing(df), F.col("vec_id") % 100 == 0))
    assert recall(wanted, found) >= 0.9
    assert seen["parts"] == parts and seen["rows"] == len(rows)


def clustered(rows, clusters, dims=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims)) * 5
    return (centres[draw.integers(0, clusters, rows)] + draw.normal(size=(rows, dims))).astype(np.float32)


@pytest.mark.parametrize("branch, shared", [(64, 128), (4, 128), (4, 1)])
def test_levels_of_parts_of_clustered_vectors(spark, monkeypatch, branch, shared):
    monkeypatch.setattr(neighbours, "PART_ROWS", 128)
    monkeypatch.setattr(neighbours, "BRANCH", branch)
    monkeypatch.setattr(neighbours, "SHARED_ROUTERS", shared)
    seen = watched(monkeypatch)
    rows = list(enumerate(clustered(2000, 20).tolist()))
    wanted, found = exact(rows), by_query(search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 100 == 0))
    assert recall(wanted, found) >= 0.9
    assert neighbours.levels_for(2000) == ((1, 15) if branch == 64 else (2, 4))
    assert seen["parts"] > 8 and seen["rows"] == 2000


def test_less_is_compared_as_rows_grow(spark, monkeypatch):
    seen = watched(monkeypatch)
    shares = []
    for rows in (4_000, 50_000):
        matrix = clustered(rows, 200)
        df = spark.createDataFrame(list(enumerate(matrix.tolist())), SHAPE)
        found = by_query(search(df, F.col("vec_id") % 100 == 0))
        assert recall(exact(list(enumerate(matrix))), found) >= 0.9
        assert seen["parts"] >= min(8, rows // 1024)
        shares.append(seen["pairs"] / (rows * len(found)))
    assert shares[1] < shares[0] / 2 < 0.3


def test_levels_grow_with_the_rows():
    assert [neighbours.levels_for(rows) for rows in (0, 40, 256, 2_000, 50_000)] == [(1, 1), (1, 1), (1, 8), (1, 8), (1, 48)]
    for rows in (10**5, 10**7, 10**9, 10**12):
        levels, branch = neighbours.levels_for(rows)
        assert branch <= neighbours.BRANCH and branch**levels >= rows // neighbours.PART_ROWS


def test_parts_are_balanced():
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(1000, 8))
    graph = neighbours._nearest(vectors, vectors, 10, np.arange(1000))
    sizes = np.bincount(balanced_parts(vectors, graph, 8), minlength=8)
    assert sizes.max() <= 1.1 * 1000 / 8 + 1 and sizes.min() > 0


def test_odd_vectors_and_ties(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (None, [1.0, 2.0]), (700, [1.0, 2.0, 3.0])]
    good = [(number, [1.0, 2.0]) for number in (0, 5, 3, 9, 1, 2, 4, 6, 7, 8, 11, 12)] + [(13, [1.0, 2.5]), (0, [3.0, 3.0]), (-100, [1.0, 2.0])]
    found = by_query(search(spark.createDataFrame(bad + good, SHAPE), F.col("vec_id") % 100 == 0))
    assert found == {
        0: [(-100, 0.0)] + [(number, 0.0) for number in (1, 2, 3, 4, 5, 6, 7, 8, 9)],
        -100: [(0, 0.0)] + [(number, 0.0) for number in (1, 2, 3, 4, 5, 6, 7, 8, 9)],
    }
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 2.0])], SHAPE)
    assert by_query(search(few, F.col("vec_id") % 100 == 0)) == {0: [(1, 1.0)]}
    assert search(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("copies", [3000])
def test_one_very_common_vector(spark, monkeypatch, copies):
    monkeypatch.setattr(neighbours, "PART_ROWS", 256)
    draw = np.random.default_rng(8)
    rows = [(number, [0.5] * 8) for number in range(copies)]
    rows += [(copies + number, vector) for number, vector in enumerate(draw.normal(size=(1500, 8)).astype(np.float32).tolist())]
    found = by_query(search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 100 == 0))
    assert len(found) == 45 and all(len(own) == 10 for own in found.values())
    assert found[0] == [(number, 0.0) for number in range(1, 11)]
