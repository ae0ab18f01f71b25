"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few edges
between them, and a small classifier learns in which parts the neighbours of a
vector lie. Every row is indexed under its most probable part. A query is routed
to its most probable parts, and their rows are ranked by the exact distance.
How many parts are probed is measured on sample queries that the classifier has
not seen.

A part holds about ``PART_ROWS`` rows however many rows there are. Where that
takes more parts than one classifier tells apart, parts are cut again by
classifiers of their own, level by level, each fitted by a Spark task on a
sample of its part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed

SAMPLE_ROWS = 8192
PART_ROWS = 1024
LEAST_PARTS = 8
# Parts that one classifier tells apart at most; beyond, there are more levels.
BRANCH = 64
# Classifiers that every task is handed at most (each some 100 kB); beyond, they are shuffled to their rows.
SHARED_ROUTERS = 128
# Parts whose sizes are broadcast at most.
SHARED_PARTS = 2_000_000
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
TARGET_RECALL = 0.95
# Rows and queries that one task compares at a time.
BLOCK_ROWS = 1024
BLOCK_QUERIES = 4096


def _nearest(queries: np.ndarray, rows: np.ndarray, count: int, own: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the nearest rows of each query, without row ``own``."""
    found = []
    norms = (rows**2).sum(1)
    for start in range(0, len(queries), 512):
        part = queries[start : start + 512]
        gaps = norms - 2 * part @ rows.T
        if own is not None:
            gaps[np.arange(len(part)), own[start : start + 512]] = np.inf
        count = min(count, gaps.shape[1] - 1)
        found.append(np.argpartition(gaps, count, axis=1)[:, :count])
    return np.vstack(found)


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vector: equal halves along main directions, then moves along the graph's edges.

    A node moves to the part that most of its neighbours are in while that part
    has room, so parts stay within a tenth of the same size.
    """
    part = np.zeros(len(vectors), np.int64)
    groups = [np.arange(len(vectors))]
    while len(groups) < parts:
        groups.sort(key=len)
        members = groups.pop()
        centred = vectors[members] - vectors[members].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = members[np.argsort(centred @ direction, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for number, members in enumerate(groups):
        part[members] = number
    room = int(np.ceil(1.1 * len(vectors) / parts))
    heads, tails = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    sources, targets = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    nodes = np.arange(len(vectors))
    for _ in range(rounds):
        counts = np.bincount(sources * parts + part[targets], minlength=len(vectors) * parts).reshape(-1, parts)
        wanted = counts.argmax(1)
        gain = counts[nodes, wanted] - counts[nodes, part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[wanted[node]] < room:
                sizes[part[node]] -= 1
                sizes[wanted[node]] += 1
                part[node] = wanted[node]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer; ``order`` gives all parts of a vector, the most probable first."""

    first: np.ndarray
    second: np.ndarray
    probes: int = 1

    def values(self, vectors: np.ndarray) -> np.ndarray:
        ones = np.ones((len(vectors), 1))
        hidden = np.maximum(np.hstack([_unit(vectors), ones]) @ self.first, 0)
        return np.hstack([hidden, ones]) @ self.second

    def order(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.values(vectors), axis=1, kind="stable")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to the mean length of one; only the router sees vectors this way."""
    return vectors / np.maximum(np.sqrt((vectors**2).mean(1, keepdims=True)), 1e-30)


def _fit(vectors: np.ndarray, wanted: np.ndarray, epochs: int = 40) -> Router:
    """Softmax regression of part shares over one hidden layer, by Adam."""
    draw = np.random.default_rng(11)
    dims, parts = vectors.shape[1], wanted.shape[1]
    weights = [draw.normal(0, (2 / dims) ** 0.5, (dims + 1, HIDDEN)), draw.normal(0, HIDDEN**-0.5, (HIDDEN + 1, parts))]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    inputs = np.hstack([_unit(vectors), np.ones((len(vectors), 1))])
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(inputs))
        rate = 0.01 * (1 - epoch / epochs)
        for start in range(0, len(order), 256):
            rows = order[start : start + 256]
            hidden = np.maximum(inputs[rows] @ weights[0], 0)
            outer = np.hstack([hidden, np.ones((len(rows), 1))])
            value = outer @ weights[1]
            share = np.exp(value - value.max(1, keepdims=True))
            error = (share / share.sum(1, keepdims=True) - wanted[rows]) / len(rows)
            back = (error @ weights[1][:-1].T) * (hidden > 0)
            step += 1
            for place, slope in ((1, outer.T @ error), (0, inputs[rows].T @ back)):
                mean, square = state[place]
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                weights[place] -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def learn_router(sample: np.ndarray, parts: int, neighbours: int = 10, target: float = TARGET_RECALL) -> Router:
    """Parts, classifier and number of probes from a sample of distinct vectors."""
    dims = sample.shape[1] if sample.ndim == 2 else 1
    parts = int(min(parts, max(1, len(sample) // 32)))
    if parts == 1:
        return Router(np.zeros((dims + 1, 1)), np.zeros((2, 1)), 1)
    graph = _nearest(sample, sample, GRAPH_NEIGHBOURS, np.arange(len(sample)))
    part = balanced_parts(sample, graph, parts)
    shares = np.zeros((len(sample), parts))
    for column in range(graph.shape[1]):
        np.add.at(shares, (np.arange(len(sample)), part[graph[:, column]]), 1.0)
    np.add.at(shares, (np.arange(len(sample)), part), 1.0)
    shares /= shares.sum(1, keepdims=True)
    # One in eight is kept out of the training to measure recall with.
    unseen = np.arange(len(sample)) % 8 == 0
    router = _fit(sample[~unseen], shares[~unseen])
    own = router.order(sample)
    queries = np.flatnonzero(unseen)
    near = _nearest(sample[queries], sample, neighbours, queries)
    ranks = np.empty_like(own[queries])
    np.put_along_axis(ranks, own[queries], np.arange(parts)[None, :].repeat(len(queries), 0), axis=1)
    needed = np.take_along_axis(ranks, own[near, 0], axis=1)
    recall = np.array([(needed < probes).mean() for probes in range(1, parts + 1)])
    router.probes = int(np.argmax(recall >= target)) + 1
    return router


def levels_for(rows: int) -> tuple[int, int]:
    """How many levels of classifiers, and into how many parts each of them cuts."""
    parts = max(rows // PART_ROWS, min(LEAST_PARTS, rows // 32), 1)
    levels = 1
    while BRANCH**levels < parts:
        levels += 1
    return levels, max(1, math.ceil(parts ** (1 / levels) - 1e-9))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _routers(rows: DataFrame, level: int, branch: int, dims: int, sample_rows: int, neighbours: int, target: float) -> DataFrame:
    """A classifier for every ``node`` that holds rows, fitted on a sample of its distinct vectors.

    Vectors are drawn by a hash of their own, so that copies are drawn together
    and count once; a sample exceeds ``sample_rows`` by chance only.
    """
    draw = F.shiftrightunsigned(F.xxhash64("vector", F.lit(level)), 34)
    if level:
        counted = _with(rows, rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    else:
        # All rows are in one node, which needs no join.
        counted = rows.withColumn("n", F.lit(max(1, rows.count())))
    drawn = counted.where(draw < F.lit(float(sample_rows << 30)) / F.col("n"))
    sample = drawn.select("node", "vector").distinct()

    def learn(group: pa.Table) -> pa.Table:
        vectors = _matrix(group.column("vector").combine_chunks(), dims)
        # The order in which Spark brings the rows must not matter.
        vectors = vectors[np.lexsort(vectors.T[::-1])][np.random.default_rng(7).permutation(len(vectors))]
        router = learn_router(vectors, branch, neighbours, target)
        return pa.table({"node": group.column("node")[:1], "router": pa.array([pickle.dumps(router)], pa.binary())})

    return checkpointed(sample.groupBy("node").applyInArrow(learn, "node long, router binary"), "routers")


def _with(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their part; the facts are broadcast up to ``SHARED_PARTS`` parts."""
    known = facts.persist()
    return rows.join(F.broadcast(known) if known.count() <= SHARED_PARTS else known, key)


def _step(rows: DataFrame, routers: DataFrame, dims: int, branch: int, queries: bool, count: int) -> DataFrame:
    """Rows moved from their node to a child of it, queries to each child that they probe.

    ``routers`` hold ``node``, ``router`` and ``held``: how many rows every
    child has. A query probes further children until those before hold more
    rows than it wants.
    """

    def children(router: Router, held: list[int], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the children that they go to."""
        order = router.order(vectors)
        if not queries:
            return np.arange(len(vectors)), order[:, 0]
        sizes = np.array(held + [0] * (order.shape[1] - len(held)), np.int64)[order]
        before = np.cumsum(sizes, 1) - sizes
        wanted = ((np.arange(order.shape[1]) < router.probes) | (before <= count)) & (sizes > 0)
        at, place = np.nonzero(wanted)
        return at, order[at, place]

    def moved(ids: pa.Array, vectors: pa.Array, node: int, router: Router, held: list[int]) -> pa.RecordBatch:
        at, child = children(router, held, _matrix(vectors, dims))
        chosen = pa.array(at)
        columns = [ids.take(chosen), vectors.take(chosen), pa.array(node * branch + child.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["id", "vector", "node"])

    shape = "id long, vector array<double>, node long"
    if routers.count() <= SHARED_ROUTERS:
        known = {row["node"]: (pickle.loads(row["router"]), list(row["held"])) for row in routers.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes = batch.column(2).to_numpy()
                for node in np.unique(nodes):
                    own = batch.filter(pa.array(nodes == node))
                    yield moved(own.column(0), own.column(1), int(node), *shared.value[int(node)])

        return rows.select("id", "vector", "node").mapInArrow(place, shape)

    # Blocks of a node's rows, so that no task holds a large node.
    lots = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("lots"))
    block = F.pmod(F.xxhash64("id", "vector"), F.col("lots")).cast("int").alias("block")
    dealt = _with(rows, lots, "node").select("id", "vector", "node", block)
    copied = routers.join(lots, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))

    def meet(own: pa.Table, router: pa.Table) -> pa.Table:
        if not own.num_rows or not router.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float64())), "node": pa.array([], pa.int64())})
        fitted, held = pickle.loads(router.column("router")[0].as_py()), router.column("held")[0].as_py()
        vectors = own.column("vector").combine_chunks()
        batch = moved(own.column("id").combine_chunks(), vectors, own.column("node")[0].as_py(), fitted, held)
        return pa.Table.from_batches([batch])

    return dealt.groupBy("node", "block").cogroup(copied.groupBy("node", "block")).applyInArrow(meet, shape)


def _best(queries: pa.Table, rows: pa.Table, dims: int, count: int) -> pa.Table:
    """The nearest rows of each query in one block, by distance, then id."""
    ids = rows.column("id").to_numpy()
    matrix = _matrix(rows.column("vector").combine_chunks(), dims)
    wanted = _matrix(queries.column("vector").combine_chunks(), dims)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, vector in zip(queries.column("id").to_pylist(), wanted):
        score = np.sqrt(((matrix - vector) ** 2).sum(1))
        score[ids == query] = np.inf
        # Everything as near as the last one wanted, so that ties go to the smaller id.
        last = np.partition(score, count - 1)[count - 1] if len(score) >= count else np.inf
        near = np.flatnonzero((score <= last) & (ids != query))
        near = near[np.lexsort((ids[near], score[near]))][:count]
        found.append((np.full(len(near), query), ids[near], score[near]))
    columns = [np.concatenate(part) for part in zip(*found)] if found else [[], [], []]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(values, kind) for values, kind in zip(columns, kinds)], ["query_id", "vec_id", "score"])


def search(
    embeddings: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    count: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``count`` nearest rows found for each query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id. Rows take no part if their id or vector is null or their vector
    holds null or non-finite components, is zero or has another length than
    most. Candidates of a query are all rows with another id; of several query
    rows with one id the smallest vector asks. Every row is indexed; each
    classifier is fitted on about ``sample_rows`` distinct vectors, drawn by a
    hash, and probes so many parts that the recall on rows it has not seen is
    ``target_recall`` over all levels. A query probes further parts until they
    hold more rows than it wants, so it gets ``count`` rows if there are as
    many. An empty table gives no rows; other columns are not read.
    """
    # Queries are marked on the caller's columns, before any is renamed.
    marked = embeddings.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = marked.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, total = (sizes["dims"], sizes["count"]) if sizes else (1, 0)
    marked = marked.where(F.size("vector") == dims)
    root = F.lit(0).cast("long").alias("node")
    index = marked.select("id", "vector", root)
    asked = marked.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector", root)
    levels, branch = levels_for(total)
    for level in range(levels):
        routers = _routers(index, level, branch, dims, sample_rows, count, target_recall ** (1 / levels))
        blank = F.array().cast("array<long>").alias("held")
        index = checkpointed(_step(index, routers.select("node", "router", blank), dims, branch, False, count), "vector-index")
        child = F.struct(F.pmod("node", F.lit(branch)).cast("int").alias("child"), F.col("count").alias("n"))
        filled = index.groupBy("node").count().select(F.floor(F.col("node") / branch).alias("node"), child.alias("one"))
        held = filled.groupBy("node").agg(F.map_from_entries(F.collect_list("one")).alias("sizes"))
        every = F.transform(F.sequence(F.lit(0), F.lit(branch - 1)), lambda at: F.coalesce(F.try_element_at("sizes", at), F.lit(0)))
        full = routers.join(held, "node").select("node", "router", every.alias("held"))
        asked = checkpointed(_step(asked, full, dims, branch, True, count), "routed-queries")
    return _compared(index, asked, dims, count)


def _compared(index: DataFrame, asked: DataFrame, dims: int, count: int) -> DataFrame:
    """The nearest rows among those that share a part with a query, part by part in blocks."""
    rows = index.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    asks = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    # Into how many blocks each part's rows and queries are cut.
    plan = checkpointed(rows.join(asks, "node"), "neighbour-plan")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    block = lambda name, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(name)).cast("int")
    rows_side = _with(index, plan, "node").select(
        "node", block("row_blocks", 1).alias("row_block"), every("query_blocks").alias("query_block"), "id", "vector"
    )
    query_side = _with(asked, plan, "node").select(
        "node", every("row_blocks").alias("row_block"), block("query_blocks", 2).alias("query_block"), "id", "vector"
    )
    keys = ["node", "row_block", "query_block"]

    def rank(queries: pa.Table, own: pa.Table) -> pa.Table:
        return _best(queries, own, dims, count)

    found = query_side.groupBy(*keys).cogroup(rows_side.groupBy(*keys)).applyInArrow(
        rank, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
