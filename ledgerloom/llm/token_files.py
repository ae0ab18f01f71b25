"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of whole documents in blocks of 128. A block keeps its
smallest id and the differences from it in a width that suits nine tenths of
them; the high bits of the others are exceptions. The header says where each
block starts, so any range of ids can be read alone.

A table of token files is a folder of Parquet files with one row per segment:
Spark writes them through its committer to any shared store, and a lost task is
simply run again. Rows also say which documents a segment holds, so a reader
needs no other index.

Segment bytes, little-endian: ``PFR1``, number of ids (u32), number of blocks B
(u32), number of exceptions E (u32), then smallest ids (B x u32), widths
(B x u8), exceptions per block (B x u8), block starts in 64-bit words
(B+1 x u32), places of exceptions (E x u8), their high bits (E x u32), padding
to 8 bytes, packed words (u64).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices
from ledgerloom.llm.tokens import encoder
from ledgerloom.session import scratch_folder

MAGIC = b"PFR1"
BLOCK = 128
KEPT_SHARE = 0.9
SEGMENT_IDS = 1 << 18
END_ID = 2


def _bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of unsigned 32-bit numbers; a double holds them exactly."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    count = len(ids)
    blocks = -(-count // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:count] = ids
    padded[count:] = ids[-1] if count else 0
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    bits = _bit_length(rest)
    rank = int(BLOCK * KEPT_SHARE)
    widths = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    over = bits > widths[:, None]
    block_of, places = np.nonzero(over)
    highs = (rest[block_of, places].astype(np.uint64) >> widths[block_of].astype(np.uint64)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(widths.astype(np.int64) * (BLOCK // 64)))).astype(np.uint32)
    words = np.zeros(int(starts[-1]), np.uint64)
    for width in np.unique(widths).tolist():
        if width == 0:
            continue
        chosen = np.flatnonzero(widths == width)
        low = (rest[chosen].astype(np.uint64) & np.uint64((1 << width) - 1)).T.copy()
        packed = np.zeros((width * BLOCK // 64, len(chosen)), np.uint64)
        for place in range(BLOCK):
            word, shift = divmod(place * width, 64)
            packed[word] |= low[place] << np.uint64(shift)
            if shift + width > 64:
                packed[word + 1] |= low[place] >> np.uint64(64 - shift)
        words[(starts[chosen].astype(np.int64)[:, None] + np.arange(len(packed))).ravel()] = packed.T.ravel()
    head = MAGIC + np.array([count, blocks, len(highs)], "<u4").tobytes()
    body = [
        least.astype("<u4").tobytes(),
        widths.tobytes(),
        over.sum(axis=1).astype(np.uint8).tobytes(),
        starts.astype("<u4").tobytes(),
        places.astype(np.uint8).tobytes(),
        highs.astype("<u4").tobytes(),
    ]
    data = head + b"".join(body)
    return data + b"\0" * (-len(data) % 8) + words.astype("<u8").tobytes()


class Segment:
    """Reads ids back, all of them or a range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.count, blocks, extra = np.frombuffer(data, "<u4", 3, 4).tolist()
        place = 16

        def take(kind: str, number: int) -> np.ndarray:
            nonlocal place
            part = np.frombuffer(data, kind, number, place)
            place += part.nbytes
            return part

        self.least, self.widths, self.extras = take("<u4", blocks), take("u1", blocks), take("u1", blocks)
        self.starts, self.places, self.highs = take("<u4", blocks + 1), take("u1", extra), take("<u4", extra)
        place += -place % 8
        self.words = take("<u8", int(self.starts[-1]))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.count if stop is None else min(stop, self.count)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        rows = self._blocks(first, last)
        return rows.ravel()[start - first * BLOCK : stop - first * BLOCK]

    def _blocks(self, first: int, last: int) -> np.ndarray:
        widths = self.widths[first:last]
        rest = np.zeros((last - first, BLOCK), np.uint32)
        for width in np.unique(widths).tolist():
            if width == 0:
                continue
            chosen = np.flatnonzero(widths == width)
            begins = self.starts[first + chosen].astype(np.int64)
            packed = self.words[begins[:, None] + np.arange(width * BLOCK // 64)].T.copy()
            low = np.empty((BLOCK, len(chosen)), np.uint64)
            for place in range(BLOCK):
                word, shift = divmod(place * width, 64)
                low[place] = packed[word] >> np.uint64(shift)
                if shift + width > 64:
                    low[place] |= packed[word + 1] << np.uint64(64 - shift)
            rest[chosen] = (low & np.uint64((1 << width) - 1)).T
        ends = np.concatenate(([0], np.cumsum(self.extras.astype(np.int64))))
        mine = slice(int(ends[first]), int(ends[last]))
        block_of = np.repeat(np.arange(last - first), self.extras[first:last])
        rest[block_of, self.places[mine]] |= self.highs[mine] << widths[block_of].astype(np.uint32)
        return rest + self.least[first:last, None]


def write_tokens(
    documents: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every text and write the token files in ascending order of the id.

    A null text counts as empty and leaves only its end id; null ids come first,
    rows with the same id in the order of their texts; other columns are not
    read. Segments end at documents, so one longer than ``segment_ids`` has a
    segment of its own. An empty table leaves files without a segment.
    """
    file = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ordered = (
        documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .select(F.spark_partition_id().alias("part"), "id", "text")
    )
    id_type = ordered.schema["id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        keys: list = []
        held: list[np.ndarray] = []
        state = {"segment": 0, "before": 0, "part": 0, "size": 0}
        schema = None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            sizes = [len(own) for own in held]
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([state["part"]], pa.int32()),
                    pa.array([state["segment"]], pa.int64()),
                    pa.array([state["before"]], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([keys], pa.list_(schema)),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([pack(ids)], pa.binary()),
                ],
                ["part", "segment", "before", "n_ids", "doc_ids", "doc_tokens", "payload"],
            )
            state["segment"] += 1
            state["before"] += len(ids)
            state["size"] = 0
            keys.clear()
            held.clear()
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            state["part"], schema = batch.column(0)[0].as_py(), batch.column(1).type
            for start, end, texts in text_slices(batch, "text"):
                own = batch.column(1).slice(start, end - start).to_pylist()
                for key, ids in zip(own, encode(texts)):
                    if held and state["size"] + len(ids) + 1 > segment_ids:
                        yield flush()
                    keys.append(key)
                    held.append(np.append(ids, np.uint32(end_id)))
                    state["size"] += len(ids) + 1
        if held:
            yield flush()

    shape = (
        "part int, segment long, before long, n_ids long, "
        f"doc_ids array<{id_type}>, doc_tokens array<long>, payload binary"
    )
    # The payload is packed already.
    ordered.mapInArrow(segments, shape).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document: ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    files = spark.read.parquet(path)
    # One number for each part of the files; parts are as many as the writing tasks.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("before")).alias("start"), "doc_ids", "doc_tokens", "payload"
    )
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = np.array(batch.column(2)[row].as_py(), np.int64)
                ids = Segment(batch.column(3)[row].as_py()).ids().astype("<u4")
                stops = np.cumsum(sizes)
                starts = stops - sizes
                sums = [zlib.crc32(ids[start:stop].tobytes()) for start, stop in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[row].values,
                        pa.array(starts + batch.column(0)[row].as_py(), pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    [id_column, "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(documents, f"`{id_column}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_digest(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the token files of all documents to the shared folder and read them back, as ``write_tokens`` orders them.

    An empty table gives no rows.
    """
    path = scratch_folder(documents.sparkSession, "token-files")
    write_tokens(documents, path, id_column, text, **options)
    return read_tokens(documents.sparkSession, path, id_column)
