"""Running counts and transaction ids over a stream of normalised rows.

A window cannot number rows across micro-batches, so the number of rows seen of
each content is kept as keyed state. The state lives in RocksDB, outside the
executors' heaps, and is part of the checkpoint: a restarted stream counts on
where it stopped.

Every call to the state is a round trip between Python and the JVM, and every
row that a stateful operator hands to Python is built one by one. So rows travel
in packs, and contents are kept in slots of about a thousand: the number of
calls follows the slots, not the rows. One bucket may hold a large share of all
rows (a monthly fee), so the tasks of the state only number rows: counted packs
are dealt out again, and all cores make of them what follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.ids import KEY, digest, keyed
from ledgerloom.operators.normalise import INGEST_ORDER

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 1024
COLLISIONS = "collisions"
# Rows that a task gathers before it packs them by bucket, and about how many bytes of them.
PACK_ROWS = 1 << 16
PACK_BYTES = 32 << 20
# A slot with more contents than this has its bucket cut into more slots.
SLOT_ENTRIES = 1024
MOST_BITS = 30
# What a slot keeps of a content: its SHA-256, its rows so far and when it last came.
ENTRY = np.dtype([("content", "<u8", 4), ("n", "<i8"), ("at", "<i8")])


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of new streams in RocksDB, which keyed state needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _runs(content: np.ndarray) -> np.ndarray:
    """Where each distinct content begins in sorted ones."""
    fresh = np.ones(len(content), bool)
    fresh[1:] = (content[1:] != content[:-1]).any(axis=1)
    return np.flatnonzero(fresh)


def _merged(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contents in order with the sums of their rows, and per entry the rows of those before it."""
    words = entries["content"]
    order = np.lexsort([words[:, place] for place in (3, 2, 1, 0)])
    ordered = entries[order]
    begins = _runs(ordered["content"])
    whole = ordered[begins]
    if len(begins):
        whole["n"] = np.add.reduceat(ordered["n"], begins)
        whole["at"] = np.maximum.reduceat(ordered["at"], begins)
    earlier = np.cumsum(ordered["n"]) - ordered["n"]
    before = np.empty(len(entries), np.int64)
    before[order] = earlier - np.repeat(earlier[begins], np.diff(np.append(begins, len(ordered))))
    return whole, before


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Content and order of rows, each content once and the rows as numbers of it."""
    return batch.set_column(0, "content", batch.column("content").dictionary_encode())


def _slots(entries: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each entry: the first bits of its content."""
    return (entries["content"][:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), np.int64)


class RunningCount(StatefulProcessor):
    """Numbers the rows of each content from where the last micro-batch left off.

    Contents are grouped into buckets, so that one call handles many of them. A
    bucket keeps its contents in ``2**bits`` slots, one state entry each; when a
    slot has grown beyond ``slot_entries`` the bucket is dealt to more slots, so
    a micro-batch reads and writes a bounded part of the state per content.
    """

    def __init__(self, days: int | None = None, slot_entries: int = SLOT_ENTRIES):
        self.kept = None if days is None else days * 86_400_000
        self.slot_entries = slot_entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "n int")
        self.counts = handle.getMapState("counts", "slot int", "entries binary", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # Packs stay compressed; only what numbers their rows is unpacked for all of them at once.
        packs = [pack for frame in rows for pack in frame["packed"]]
        coded = [_coded(_unpacked(pack, ["content", "order"])) for pack in packs]
        table = pa.Table.from_batches(coded).unify_dictionaries().combine_chunks()
        codes, contents = table.column("content").chunk(0).indices, table.column("content").chunk(0).dictionary
        words = np.frombuffer(contents.cast(pa.binary(32)).buffers()[1], ENTRY["content"].base)
        content = words.reshape(-1, 4)[: len(contents)]
        keys = table.set_column(0, "content", codes)
        placed = pc.sort_indices(keys, sort_keys=[("content", "ascending"), ("order", "ascending")]).to_numpy()
        sizes = np.bincount(codes.to_numpy(), minlength=len(content))
        begins = np.cumsum(sizes) - sizes
        now = 0 if self.kept is None else timer_values.getCurrentProcessingTimeInMs()
        fresh = np.zeros(len(content), ENTRY)
        fresh["content"], fresh["n"], fresh["at"] = content, sizes, now
        before = self._counted_on(fresh, now)
        occurrence = np.empty(len(placed), np.int64)
        occurrence[placed] = np.arange(len(placed)) + np.repeat(before - begins, sizes)
        start = 0
        for pack in packs:
            batch = _unpacked(pack)
            numbers = pa.array(occurrence[start : start + batch.num_rows])
            start += batch.num_rows
            counted = batch.drop_columns(["content", "order"]).append_column("occurrence", numbers)
            yield pd.DataFrame({"packed": [_packed(counted)]})

    def _counted_on(self, fresh: np.ndarray, now: int) -> np.ndarray:
        """Adds distinct contents to the state; returns how often each came before."""
        known = self.bits.get()
        bits = 0 if known is None else int(known[0])
        touched = np.unique(_slots(fresh, bits)).tolist()
        stored = [self.counts.getValue((slot,)) for slot in touched]
        held = self._living([value[0] for value in stored if value is not None], now)
        whole, before = _merged(np.concatenate([held, fresh]))
        largest = int(np.bincount(np.searchsorted(touched, _slots(whole, bits))).max())
        if largest > self.slot_entries and bits < MOST_BITS:
            # All other slots are dealt anew with these; as slots at least double, this is rare.
            mine = set(touched)
            others = [value[0] for slot, value in self.counts.iterator() if slot[0] not in mine]
            bits = min(MOST_BITS, bits + (2 * largest // self.slot_entries).bit_length())
            whole = np.concatenate([whole, self._living(others, now)])
            whole = whole[np.argsort(_slots(whole, bits), kind="stable")]
            self.counts.clear()
            self.bits.update((bits,))
        slots = _slots(whole, bits)
        cuts = np.flatnonzero(np.diff(slots, prepend=-1))
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)]):
            self.counts.updateValue((int(slots[start]),), (whole[start:stop].tobytes(),))
        return before[len(held) :]

    def _living(self, stored: list[bytes], now: int) -> np.ndarray:
        """The entries of some slots without those that were not touched for too long."""
        entries = np.frombuffer(b"".join(map(bytes, stored)), ENTRY)
        return entries if self.kept is None else entries[entries["at"] + self.kept > now]

    def close(self) -> None:
        pass


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(pack: bytes, names: list[str] | None = None) -> pa.RecordBatch:
    """The rows of a pack, or only some of their columns."""
    options = pa.ipc.IpcReadOptions()
    if names is not None:
        with pa.ipc.open_stream(pack) as reader:
            options.included_fields = [reader.schema.get_field_index(name) for name in names]
    with pa.ipc.open_stream(pack, options=options) as reader:
        batch = reader.read_next_batch()
    return batch if names is None else batch.select(names)


def pack_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket`` and ``packed``: rows of a task by bucket; the bucket is the last column."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield _by_bucket(held)
            held, rows, size = [], 0, 0
    if rows:
        yield _by_bucket(held)


def _by_bucket(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    buckets = table.column("bucket").to_numpy()
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=-1))
    rows = table.drop_columns(["bucket"]).take(pa.array(order)).combine_chunks().to_batches()[0]
    stops = np.append(cuts[1:], len(ordered))
    packs = [_packed(rows.slice(start, stop - start)) for start, stop in zip(cuts.tolist(), stops.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ordered[cuts], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "packed"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (_unpacked(pack.as_py()) for pack in batch.column(0))


def running_occurrence(
    rows: DataFrame, buckets: int = BUCKETS, days: int | None = None, slot_entries: int = SLOT_ENTRIES
) -> DataFrame:
    """A stream of keyed rows (``operators.ids.keyed``) without the parts of their id, with their ``occurrence``.

    Equal to the batch count of all rows up to and including the micro-batch, if
    the ``_ingest_order`` grows from one micro-batch to the next. A restart on
    the same checkpoint continues the count. The state has 48 bytes per content;
    ``days`` drops contents that were not touched for so long, after which a
    content counts from 0 again. One task holds the packed rows of a bucket of
    one micro-batch, a few numbers of each and its distinct contents, so the
    source's limit per micro-batch bounds its memory. What follows the count runs
    in as many tasks as the session shuffles into, and at least one per core,
    whatever the buckets hold.
    """
    spark = rows.sparkSession
    use_rocksdb(spark)
    # The length keeps an import's name apart from the parts of the key.
    group = F.concat_ws(":", F.coalesce(F.length("_group"), F.lit(-1)).cast("string"), F.col("_group"))
    content = F.unhex(F.sha2(F.concat_ws("|", group, *[F.col(name).cast("string") for name in KEY]), 256))
    parts = {*KEY, "_crowd", "_hash", "_value", "_order", "_group"}
    kept = [name for name in rows.columns if name not in parts]
    # Own names by place, apart from those the packs add.
    names = [f"c{place}" for place in range(len(kept))]
    own = [F.col(f"`{name}`").alias(place) for name, place in zip(kept, names)]
    narrow = rows.select(*own, F.col(INGEST_ORDER).alias("order"), content.alias("content"))
    placed = narrow.withColumn("bucket", F.pmod(F.xxhash64("content"), F.lit(buckets)).cast("int"))
    packed = placed.mapInArrow(pack_by_bucket, "bucket int, packed binary")
    counted = packed.groupBy("bucket").transformWithStateInPandas(
        RunningCount(days, slot_entries), "packed binary", "append", "none" if days is None else "processingTime"
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = counted.repartition(tasks)
    shape = T.StructType([T.StructField(place, narrow.schema[place].dataType) for place in names])
    return dealt.mapInArrow(unpack, shape.add("occurrence", T.LongType())).toDF(*kept, "occurrence")


def stream_occurrence(frames: DataFrame, buckets: int = BUCKETS, days: int | None = None) -> DataFrame:
    """Normalised rows of a stream with their running ``occurrence`` and nothing else added."""
    return _counted(frames, buckets, days).select(*frames.columns, "occurrence")


def stream_txn_ids(frames: DataFrame, buckets: int = BUCKETS, days: int | None = None) -> DataFrame:
    """A stable ``txn_id`` in front of every row of a stream, as ``assign_txn_ids`` gives in batch.

    Every micro-batch reports ``repeated_rows`` and ``rows`` as the observed
    metric ``collisions``; see ``collisions_of``.
    """
    # The parts of the id are computed again, which is cheaper than to send them along.
    counted = keyed(_counted(frames, buckets, days))
    parts = [F.col(name).cast("string") for name in [*KEY, "occurrence"]]
    repeated = F.count_if(F.col("occurrence") > 0).alias("repeated_rows")
    observed = counted.observe(COLLISIONS, repeated, F.count(F.lit(1)).alias("rows"))
    return observed.select(digest(*parts).alias("txn_id"), *frames.columns)


def _counted(frames: DataFrame, buckets: int, days: int | None) -> DataFrame:
    if INGEST_ORDER not in frames.columns:
        raise ValueError(f"a stream needs the column {INGEST_ORDER} to number equal rows")
    return running_occurrence(keyed(frames), buckets, days)


def collisions_of(query: StreamingQuery) -> tuple[int, int]:
    """Rows with an occurrence above zero, and all rows, of the micro-batches the query still reports."""
    found = [progress.observedMetrics.get(COLLISIONS) for progress in query.recentProgress]
    known = [row for row in found if row is not None]
    return sum(row["repeated_rows"] for row in known), sum(row["rows"] for row in known)
