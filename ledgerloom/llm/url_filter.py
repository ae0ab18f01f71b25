"""URL rules by Bloom filter cascades.

Every listed key is looked up without a join: a cascade of Bloom filters tells
for each key of the corpus whether it is listed. Level 1 holds the listed keys,
level 2 the corpus keys that pass level 1 though they are not listed, level 3
the listed keys that pass level 2, and so on until no key passes wrongly. Over
the keys the cascade was built for, its answers are exact.

Filters are built in tasks, segment by segment. A rule list whose first filters
would take more than ``filter_bytes`` is cut into parts by a hash of the key, and
the corpus is judged once per part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, parts_for

# First filters that travel to every task at a time; longer rule lists are judged in parts.
FILTER_BYTES = 64 << 20
# Hash pairs of which the driver builds the rest of a cascade; more are narrowed in tasks.
DRIVER_PAIRS = 1 << 20
SEGMENT_BITS = 1 << 20
MAX_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _filter_bits(count: int, rate: float) -> int:
    return max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    depth: int

    @staticmethod
    def empty(count: int, rate: float, depth: int = 1) -> Level:
        """A filter without bits yet that passes other pairs at about ``rate`` once it holds ``count``.

        Each depth has hash functions of its own, or what passes two levels
        wrongly would pass all further ones.
        """
        size = _filter_bits(count, rate)
        return Level(np.zeros((size + 7) // 8, np.uint8), size, max(1, round(-math.log2(rate))), depth)

    @staticmethod
    def of(pairs: np.ndarray, rate: float, depth: int = 1) -> Level:
        level = Level.empty(len(pairs), rate, depth)
        for places in level.places(pairs):
            np.bitwise_or.at(level.bits, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
        return level

    def places(self, pairs: np.ndarray) -> Iterator[np.ndarray]:
        turn = np.uint64((2 * self.depth + 1) * 0x9E3779B97F4A7C15 % 2**64)
        first, second = pairs[:, 0] * turn, (pairs[:, 1] ^ turn) | np.uint64(1)
        first = first ^ (first >> np.uint64(31))
        for number in range(self.hashes):
            mixed = first + np.uint64(number) * second
            mixed ^= mixed >> np.uint64(32)
            yield (mixed % np.uint64(self.size)).astype(np.int64)

    def passes(self, pairs: np.ndarray) -> np.ndarray:
        found = np.ones(len(pairs), bool)
        for places in self.places(pairs):
            found &= (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        return found


def is_listed(levels: list[Level], pairs: np.ndarray) -> np.ndarray:
    """Membership by the first level that stops a key: an odd one says no, an even one yes."""
    listed = np.full(len(pairs), len(levels) % 2 == 1)
    open_rows = np.arange(len(pairs))
    for depth, level in enumerate(levels, 1):
        passed = level.passes(pairs[open_rows])
        listed[open_rows[~passed]] = depth % 2 == 0
        open_rows = open_rows[passed]
    return listed


def further_levels(levels: list[Level], members: np.ndarray, others: np.ndarray) -> list[Level]:
    """``levels`` and all that follow, from the listed pairs and the unlisted ones that pass them all."""
    levels = list(levels)
    wrong, right = (others, members) if len(levels) % 2 else (members, others)
    while len(wrong):
        _check_depth(levels)
        levels.append(Level.of(wrong, 0.5, len(levels) + 1))
        wrong, right = right[levels[-1].passes(right)], wrong
    return levels


def _check_depth(levels: list[Level]) -> None:
    if len(levels) >= MAX_LEVELS:
        raise ValueError("two keys share both hashes: the cascade cannot tell them apart")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (lower-cased A-Z) and ``path``; both empty without ``://``."""
    match = r"://([^/?#]*)([^?#]*)"
    part = lambda group: F.coalesce(F.regexp_extract(F.col(url), match, group), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2)})


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The lookup keys of one URL: a host ending and a path start for each shape of rule.

    A shape is the number of labels and of path characters that some rule has,
    so the number of keys follows the shapes, not the rules.
    """
    labels = F.when(F.col("host") == "", F.lit(0)).otherwise(
        F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    )
    return F.array(
        *[
            F.when(
                (labels >= count) & (F.length("path") >= chars),
                F.concat(F.substring_index("host", ".", -count), F.substring("path", 1, chars)),
            )
            for count, chars in shapes
        ]
    )


def _hashes(key: Column) -> Column:
    return F.when(key.isNotNull(), F.array(F.xxhash64(key), F.xxhash64(F.concat(key, F.lit("#")))))


def _list_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a two-number list column that are not null, and their pairs."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return rows, column.drop_null().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)


def _rules(rules: DataFrame) -> DataFrame:
    """``key``, ``verdict``, ``pair``, ``labels`` and ``chars`` of each rule that can fit a URL.

    A key listed with two verdicts keeps the greater one (block over allow). A
    host with ``/``, ``?`` or ``#`` and a path that does not begin with ``/`` fit
    none, and their keys could be those of other rules.
    """
    host = F.translate("host", _UPPER, _LOWER)
    fitting = F.col("verdict").isNotNull() & ~F.col("host").rlike("[/?#]") & F.col("path").rlike("^(/|$)")
    whole = rules.where(fitting).select(host.alias("host"), "path", "verdict")
    merged = whole.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = F.concat("host", "path")
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    return merged.select(key.alias("key"), "verdict", _hashes(key).alias("pair"), labels.alias("labels"), F.length("path").alias("chars"))


def _part(pair: Column, parts: int) -> Column:
    return F.pmod(F.get(pair, F.lit(1)), F.lit(parts))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    default: str = "allow",
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    ``rules`` has ``host``, ``path`` and ``verdict``; a rule fits its host and
    all subdomains if the URL's path starts with the rule's path. Without a rule
    (also for a null URL, one without ``://`` or an empty table) ``rule`` is null
    and ``verdict`` is ``default``. Rows are kept one for one, ids may repeat or
    be null, other columns of ``pages`` are not read. Of two rules of equal
    length the one with the longer host wins. First filters of more than
    ``filter_bytes`` are judged in parts, each a pass over the URLs; the rows are
    the same.
    """
    listed = checkpointed(_rules(rules), "url-rules")
    parsed = with_host_and_path(pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"))).drop("url")
    shapes = sorted(
        ((row["labels"], row["chars"]) for row in listed.select("labels", "chars").distinct().collect()),
        key=lambda shape: (-shape[0], -shape[1]),
    )
    if not shapes:
        return parsed.select(
            F.col("id").alias(id_column), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    keyed = parsed.withColumn("keys", _keys(shapes))
    universe = keyed.select(F.explode("keys").alias("key")).where(F.col("key").isNotNull())
    count = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    sizes = {row["verdict"]: row["count"] for row in listed.groupBy("verdict").count().collect()}
    # The rate that leaves about as many wrong keys as there are rules, so the
    # levels beyond the first are bounded by the rule list, not by the corpus.
    rates = {verdict: min(0.5, size / max(1, 2 * count)) for verdict, size in sizes.items()}
    parts = parts_for(sum(_filter_bits(size, rates[verdict]) for verdict, size in sizes.items()) / 8, filter_bytes)
    state = keyed.withColumns({"shape": F.lit(-1), "verdict": F.lit(default)})
    for part in range(parts):
        levels = _levels(listed, universe, rates, part, parts)
        state = _judged(state, levels, shapes, part, parts)
        if part < parts - 1:
            state = checkpointed(state.drop("rule"), "judged-urls").withColumn("keys", _keys(shapes))
    return state.select(F.col("id").alias(id_column), "host", "path", "rule", "verdict")


def _levels(listed: DataFrame, universe: DataFrame, rates: dict[str, float], part: int, parts: int) -> dict[str, list[Level]]:
    """The cascade of each verdict over the keys of one part."""
    mine = listed.where(_part(F.col("pair"), parts) == part)
    keys = universe.select("key", _hashes(F.col("key")).alias("pair")).where(_part(F.col("pair"), parts) == part)
    sizes = {row["verdict"]: row["count"] for row in mine.groupBy("verdict").count().collect()}
    first = {
        verdict: _filled(mine.where(F.col("verdict") == verdict), Level.empty(size, rates[verdict]))
        for verdict, size in sizes.items()
    }
    either = _passing(keys, first).withColumn("listed", F.lit(False))
    either = either.unionByName(mine.select("key", "verdict", F.lit(True).alias("listed")))
    merged = either.groupBy("verdict", "key").agg(F.max("listed").alias("listed"))
    known = checkpointed(merged.select("verdict", _hashes(F.col("key")).alias("pair"), "listed"), "passing-keys")
    return {verdict: _cascade(known.where(F.col("verdict") == verdict), level) for verdict, level in first.items()}


def _cascade(known: DataFrame, first: Level) -> list[Level]:
    """All levels after ``first``, from the pairs that pass it: in tasks while they are many, then on the driver."""
    levels = [first]
    while known.count() > DRIVER_PAIRS:
        _check_depth(levels)
        wrong = F.col("listed") == (len(levels) % 2 == 0)
        size = known.where(wrong).count()
        if not size:
            return levels
        levels.append(_filled(known.where(wrong), Level.empty(size, 0.5, len(levels) + 1)))
        known = checkpointed(known.where(wrong).unionByName(_kept(known.where(~wrong), levels[-1])), "open-keys")
    rows = known.select("pair", "listed").toArrow().combine_chunks()
    listed = rows.column("listed").to_numpy()
    pairs = rows.column("pair").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 2)
    return further_levels(levels, pairs[listed], pairs[~listed])


def _filled(members: DataFrame, level: Level) -> Level:
    """``level`` with the bits of all members: tasks list the places by segment, others set them."""
    blank = replace(level, bits=np.zeros(0, np.uint8))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, pairs = _list_pairs(batch.column(0))
            found = np.unique(np.concatenate(list(blank.places(pairs))))
            segments, starts = np.unique(found // SEGMENT_BITS, return_index=True)
            inside = np.split((found % SEGMENT_BITS).astype(np.uint32), starts[1:])
            lists = pa.array([own.tobytes() for own in inside[: len(segments)]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), lists], ["segment", "places"])

    def merge(group: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, bool)
        for own in group.column("places"):
            bits[np.frombuffer(own.as_buffer(), np.uint32)] = True
        return pa.table({"segment": group.column("segment")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    listed = members.select("pair").mapInArrow(places, "segment long, places binary")
    for row in listed.groupBy("segment").applyInArrow(merge, "segment long, bits binary").collect():
        start = row["segment"] * (SEGMENT_BITS // 8)
        own = np.frombuffer(row["bits"], np.uint8)[: len(level.bits) - start]
        level.bits[start : start + len(own)] = own
    return level


def _kept(known: DataFrame, level: Level) -> DataFrame:
    """The rows whose pair passes a level."""
    shared = known.sparkSession.sparkContext.broadcast(level)
    place = known.columns.index("pair")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, pairs = _list_pairs(batch.column(place))
            yield batch.filter(pa.array(shared.value.passes(pairs)))

    return known.mapInArrow(test, known.schema)


def _passing(keys: DataFrame, first: dict[str, Level]) -> DataFrame:
    """``key`` and ``verdict`` of the corpus keys that pass the first filter of a verdict; some repeat."""
    shared = keys.sparkSession.sparkContext.broadcast(first)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs = _list_pairs(batch.column(1))
            for verdict, level in shared.value.items():
                # Repeats within a batch go here, so a hot host costs one row per batch.
                kept = batch.column(0).take(pa.array(np.unique(rows[level.passes(pairs)]))).unique()
                yield pa.RecordBatch.from_arrays([kept, pa.array([verdict] * len(kept), pa.string())], ["key", "verdict"])

    return keys.select("key", "pair").mapInArrow(test, "key string, verdict string")


def _judged(state: DataFrame, levels: dict[str, list[Level]], shapes: list[tuple[int, int]], part: int, parts: int) -> DataFrame:
    """``state`` with the best rule so far: that of an earlier part unless this part has a longer one."""
    shared = state.sparkSession.sparkContext.broadcast(levels)
    width = len(shapes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            keys = batch.column(batch.schema.get_field_index("keys")).flatten()
            rows, pairs = _list_pairs(batch.column(batch.schema.get_field_index("pairs")).flatten())
            lengths = batch.column(batch.schema.get_field_index("lengths")).flatten().to_numpy(zero_copy_only=False)
            before = batch.column(batch.schema.get_field_index("shape")).to_numpy()
            here = pairs[:, 1].view(np.int64) % parts == part
            rows, pairs = rows[here], pairs[here]
            names = list(shared.value)
            chosen = np.full(count * width, -1)
            for place, name in enumerate(names):
                chosen[rows[is_listed(shared.value[name], pairs)]] = place
            # Shapes come with the most labels first, so the first longest has the longer host.
            known = (chosen >= 0).reshape(count, width)
            known[np.flatnonzero(before >= 0), before[before >= 0]] = True
            best = np.where(known, lengths.reshape(count, width), -1).argmax(1)
            place = np.arange(count) * width + best
            shape = np.where(known.any(1), best, -1).astype(np.int32)
            rule = keys.take(pa.array(place, mask=shape < 0))
            olds = batch.column(batch.schema.get_field_index("verdict")).to_pylist()
            verdict = [names[own] if own >= 0 else old for own, old in zip(chosen[place].tolist(), olds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), rule, pa.array(shape), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "shape", "verdict"],
            )

    key_type = state.schema["id"].dataType.simpleString()
    columns = state.select(
        "id",
        "host",
        "path",
        "keys",
        "shape",
        "verdict",
        F.transform("keys", _hashes).alias("pairs"),
        F.transform("keys", lambda key: F.coalesce(F.length(key), F.lit(-1))).alias("lengths"),
    )
    return columns.mapInArrow(judge, f"id {key_type}, host string, path string, rule string, shape int, verdict string")
