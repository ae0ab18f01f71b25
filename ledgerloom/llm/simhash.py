"""Near duplicates by SimHash and an inverted index on byte positions.

Two fingerprints of eight bytes that differ in at most three bits differ in at
most three bytes, so they share at least five positional bytes. The index lists
fingerprints under sets of (position, byte); the sets are chosen so that any
five positions contain one of them. Within a list the shared positional bytes
of each pair are tallied, pairs under the guaranteed minimum of five are
dropped, and the others are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, text_slices
from ledgerloom.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
BYTES = 8
# Lists beyond this are split by two more positions.
LIST_LIMIT = 4096
# Up to so many members all links of a list are kept, beyond it a spanning forest of them.
ALL_LINKS = 32
# Fingerprints with more than one in so many rows are joined by broadcast.
HOT_SHARE = 1000
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the shingles' XXH64 hashes; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    count = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _SHINGLES_AT_ONCE):
        part = words[start : start + _SHINGLES_AT_ONCE + size - 1]
        shingles = map(b" ".join, zip(*(part[shift:] for shift in range(size))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed number) of every row; a null text counts as empty."""
    columns = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch, "text"):
                values = np.array([fingerprint(value, shingle_words) for value in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(values.view(np.int64))], ["id", "fp"]
                )

    return columns.mapInArrow(hashed, f"id {columns.schema['id'].dataType.simpleString()}, fp long")


def position_sets(width: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` positions such that any ``shared`` of the eight positions contain one (greedy cover)."""
    open_sets = {frozenset(some) for some in combinations(range(BYTES), shared)}
    chosen = []
    while open_sets:
        best = max(combinations(range(BYTES), width), key=lambda some: sum(open_set.issuperset(some) for open_set in open_sets))
        chosen.append(best)
        open_sets = {open_set for open_set in open_sets if not open_set.issuperset(best)}
    return chosen


def _list_key(positions: tuple[int, ...], fp: Column) -> Column:
    """Which list: the positions in the top byte's place by number, their bytes below."""
    mask = sum(0xFF << (8 * position) for position in positions)
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.struct(
        F.lit(sum(1 << position for position in positions)).alias("positions"), fp.bitwiseAND(F.lit(signed)).alias("bytes")
    )


def _listed(rows: DataFrame, keys: Column) -> DataFrame:
    return rows.select("fp", F.explode(keys).alias("key")).select("key.positions", "key.bytes", "fp")


def _lists(listed: DataFrame) -> DataFrame:
    """``positions``, ``bytes``, ``fp`` and the length of the list, for lists of at least two; rows must be distinct."""
    sizes = listed.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return listed.join(sizes, ["positions", "bytes"])


def _close(a: np.ndarray, b: np.ndarray, shared: int, max_bits: int) -> np.ndarray:
    """Tally of shared positional bytes first, then the bits themselves."""
    odd = a ^ b
    tally = (odd.view(np.uint8).reshape(*odd.shape, BYTES) == 0).sum(-1)
    return (tally >= shared) & (np.bitwise_count(odd) <= max_bits)


def _forest(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that connect what all pairs connect, at most ``count - 1``."""
    parent = list(range(count))

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    kept = []
    for first, second in pairs:
        for a, b in zip(first.tolist(), second.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def _tiles(fps: np.ndarray, shared: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, (1 << 20) // len(fps))
    for start in range(0, len(fps), step):
        rows = fps[start : start + step]
        found = _close(np.repeat(rows[:, None], len(fps), 1), np.broadcast_to(fps, (len(rows), len(fps))), shared, max_bits)
        a, b = np.nonzero(found)
        a = a + start
        yield a[a < b], b[a < b]


def _probes(fps: np.ndarray, positions: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links of a long list by looking up each change of up to ``max_bits`` of the free bits."""
    order = np.argsort(fps)
    ordered = fps[order]
    free = [8 * place + bit for place in range(BYTES) if not positions >> place & 1 for bit in range(8)]
    for count in range(1, max_bits + 1):
        for bits in combinations(free, count):
            change = np.uint64(sum(1 << bit for bit in bits))
            wanted = ordered ^ change
            place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
            hit = np.flatnonzero((ordered[place] == wanted) & (ordered < wanted))
            yield order[hit], order[place[hit]]


def _links(lists: DataFrame, shared: int, max_bits: int) -> DataFrame:
    """Verified links within lists; rows of a list arrive in a row."""
    sorted_lists = lists.repartition("positions", "bytes").sortWithinPartitions("positions", "bytes", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, missing = [], 0
        for batch in batches:
            held.append([batch.column(place).to_numpy(zero_copy_only=False) for place in range(4)])
            missing -= batch.num_rows
            # A list that goes on beyond this batch is put together once, when its last row is here.
            if missing > 0 or not batch.num_rows:
                continue
            own = [np.concatenate(parts) for parts in zip(*held)]
            positions, masked, _, sizes = own
            begins = np.concatenate(([True], (positions[1:] != positions[:-1]) | (masked[1:] != masked[:-1])))
            last = int(np.flatnonzero(begins)[-1])
            missing = last + int(sizes[last]) - len(positions)
            held, own = ([[part[last:] for part in own]], [part[:last] for part in own]) if missing > 0 else ([], own)
            if len(own[0]):
                yield _verified(own, shared, max_bits)
        if missing > 0:
            raise RuntimeError(f"a list of fingerprints is not whole: {missing} did not come")

    return sorted_lists.select("positions", "bytes", "fp", "size").mapInArrow(verify, "a long, b long").distinct()


def _verified(rows: list[np.ndarray], shared: int, max_bits: int) -> pa.RecordBatch:
    positions, masked, fps, sizes = rows
    fps = fps.view(np.uint64)
    firsts, seconds = [], []
    small = np.flatnonzero(sizes <= ALL_LINKS)
    for shift in range(1, ALL_LINKS):
        small = small[small < len(fps) - shift]
        small = small[(positions[small] == positions[small + shift]) & (masked[small] == masked[small + shift])]
        if not len(small):
            break
        found = small[_close(fps[small], fps[small + shift], shared, max_bits)]
        firsts.append(fps[found])
        seconds.append(fps[found + shift])
    large = np.flatnonzero(sizes > ALL_LINKS)
    place = 0
    while place < len(large):
        start = int(large[place])
        count = int(sizes[start])
        group = fps[start : start + count]
        free = 8 * (BYTES - int(positions[start]).bit_count())
        probes = free + free * (free - 1) // 2 + free * (free - 1) * (free - 2) // 6
        if count > LIST_LIMIT and count > 8 * probes:
            pairs = _probes(group, int(positions[start]), max_bits)
        else:
            pairs = _tiles(group, shared, max_bits)
        kept = np.array(_forest(count, pairs), np.int64).reshape(-1, 2)
        firsts.append(group[kept[:, 0]])
        seconds.append(group[kept[:, 1]])
        place += count
    a = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
    b = np.concatenate(seconds) if seconds else np.zeros(0, np.uint64)
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT, width: int = 3) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` within ``max_bits`` bits.

    Lists are keyed by ``width`` positional bytes (wider keys make more but
    shorter lists). A list over ``list_limit`` is split by two more of its free
    positions, of which a linked pair must share as many; what then is still
    long has at most 2^24 members, whose changes of up to ``max_bits`` bits are
    looked up. No list is cut short.
    """
    shared = BYTES - max_bits
    sets = position_sets(width, shared)
    lists = _lists(_listed(distinct, F.array(*[_list_key(positions, F.col("fp")) for positions in sets])))
    short = lists.where(F.col("size") <= list_limit)
    long = lists.where(F.col("size") > list_limit)
    more = min(2, shared - width)
    finer = []
    for positions in sets:
        rest = [position for position in range(BYTES) if position not in positions]
        keys = [_list_key(tuple(sorted((*positions, *extra))), F.col("fp")) for extra in combinations(rest, more)]
        mine = F.col("positions") == sum(1 << position for position in positions)
        finer.append(F.when(mine, F.array(*keys)))
    # Five positions may hold several of the sets: a fingerprint comes to the same list from each long one.
    fine = _lists(_listed(long, F.coalesce(*finer)).distinct())
    return _links(short.unionByName(fine), shared, max_bits)


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """Per row its ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints that differ
    in at most ``max_bits`` bits, its own included. Texts without words (null,
    empty) have fingerprint zero and link like others. Rows are kept one for
    one; ids may repeat; a null id is never a component's id unless all ids of
    the component are null. An empty table gives no rows; other columns are not
    read.
    """
    hashed = checkpointed(fingerprints(documents, id_column, text, shingle_words), "fingerprints")
    counted = hashed.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = checkpointed(counted, "distinct-fingerprints")
    roots = components(fingerprint_links(distinct.select("fp"), max_bits, list_limit))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_linked = linked.select("node", "root").join(smallest, "root").select(F.col("node").alias("fp"), "component")
    known = checkpointed(
        distinct.join(of_linked, "fp", "left").select("fp", "copies", F.coalesce("component", "least").alias("component_id")),
        "known-fingerprints",
    )
    # A fingerprint may have a third of all rows. Those with more than a
    # thousandth are at most a thousand: their rows stay where they are.
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    common = F.broadcast(known.where(F.col("copies") > total // HOT_SHARE).drop("copies"))
    others = known.where(F.col("copies") <= total // HOT_SHARE).drop("copies")
    of_common = hashed.join(common, "fp")
    of_others = hashed.join(common.select("fp"), "fp", "left_anti").join(others, "fp")
    return of_common.unionByName(of_others).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, all columns: the one with the smallest id.

    Rows with the same id are told apart by the hash of their text; of rows
    alike in both one stays. Null ids count as larger than any; an empty table
    stays empty.
    """
    parts = {"missing": F.col(id_column).isNull(), "id": F.col(id_column), "hash": F.xxhash64(text)}
    key = F.struct(*[value.alias(name) for name, value in parts.items()])
    judged = near_duplicates(documents.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **options)
    kept = checkpointed(judged.where("key = component_id").select("key.*").distinct(), "kept-documents")
    rows = documents.select(F.struct("*").alias("row"), *[value.alias(name) for name, value in parts.items()])
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["missing"] == kept["missing"]) & (rows["hash"] == kept["hash"])
    alike = Window.partitionBy("missing", "id", "hash").orderBy("hash")
    chosen = rows.join(kept, same, "left_semi").withColumn("number", F.row_number().over(alike)).where("number = 1")
    return chosen.select("row.*")
