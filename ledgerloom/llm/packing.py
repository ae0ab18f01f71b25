"""Packing of token ids into windows of several context sizes.

Documents are routed to the tier whose window they need: one longer than the
longest window is first cut into full windows, what is left of it goes the way
of a short document. Each tier, the longest first, opens a window per document
and fills the gap from the shorter tiers, largest fitting piece first; where no
piece fits, one is cut, so a window is always full. Full windows of any tier
need no padding. Windows are dealt to step groups so that the groups of a task
hold the same number of tokens.

Every task packs the documents it reads: no ids are shuffled, and what is open
at a time is bounded by the pool.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices
from ledgerloom.llm.tokens import encoder

LONGEST = 2048
SHORTEST = 256
END_ID = 1
POOL = 4096
STEP_WINDOWS = 32

Piece = tuple[int, int, int]  # length, number of the document, start in it


class TierPacker:
    """Turns pieces into full windows, each a list of pieces whose lengths add up to a power of two."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST, pool: int = POOL):
        self.longest, self.pool = longest, pool
        self.tiers = [longest]
        while self.tiers[-1] // 2 >= shortest:
            self.tiers.append(self.tiers[-1] // 2)
        self.waiting: list[Piece] = []

    def add(self, document: int, count: int) -> Iterator[list[Piece]]:
        """The windows that a document fills alone; the rest of it waits."""
        whole = count - count % self.longest
        for start in range(0, whole, self.longest):
            yield [(self.longest, document, start)]
        if count > whole:
            self.waiting.append((count - whole, document, whole))

    def pack(self, last: bool) -> Iterator[list[Piece]]:
        """Windows from the waiting pieces. Unless ``last``, those that could not be filled wait on."""
        pieces = sorted(self.waiting)
        self.waiting = []
        while pieces:
            piece = pieces.pop()
            tier = min((size for size in self.tiers if size >= piece[0]), default=self.longest)
            window, gap = [piece], tier - piece[0]
            while gap and pieces:
                # The largest piece that fits; all that are left are no longer than this window's first.
                place = bisect_right(pieces, (gap, 1 << 62, 1 << 62))
                if place:
                    filler = pieces.pop(place - 1)
                else:
                    length, document, start = pieces.pop(0)
                    filler = (gap, document, start)
                    insort(pieces, (length - gap, document, start + gap))
                window.append(filler)
                gap -= filler[0]
            if not gap:
                yield window
            elif not last:
                self.waiting += window
            else:
                yield from self._powers(window)

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The last pieces, cut into windows of the powers of two that their total is made of."""
        total = sum(length for length, _, _ in pieces)
        rest = list(reversed(pieces))
        for power in reversed(range(total.bit_length())):
            gap, window = total & (1 << power), []
            while gap:
                length, document, start = rest.pop()
                taken = min(gap, length)
                window.append((taken, document, start))
                if taken < length:
                    rest.append((length - taken, document, start + taken))
                gap -= taken
            if window:
                yield window


def step_groups(lengths: list[int], group_tokens: int) -> list[int]:
    """A group for each window: longest first, always to the group with the fewest tokens."""
    count = max(1, round(sum(lengths) / group_tokens))
    loads = [(0, group) for group in range(count)]
    groups = [0] * len(lengths)
    for place in sorted(range(len(lengths)), key=lambda place: -lengths[place]):
        load, group = loads[0]
        groups[place] = group
        heapq.heapreplace(loads, (load + lengths[place], group))
    return groups


def pack_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    longest: int = LONGEST,
    shortest: int = SHORTEST,
    pool: int = POOL,
    step_windows: int = STEP_WINDOWS,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Every id of every row lies in exactly one piece. ``tier`` is the window size
    of the sequence and ``step_group`` the group it was dealt to. A null text
    counts as empty and leaves only its end id; ids of rows may repeat or be
    null (each row is packed as a document of its own), other columns are not
    read, an empty table has no pieces. Sequences are as long as a power of two,
    so none is padded.
    """
    file = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    columns = documents.select(
        F.spark_partition_id().alias("part"), F.col(id_column).alias("id"), F.col(text).alias("text")
    )
    id_type = columns.schema["id"].dataType.simpleString()
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        packer = TierPacker(longest, shortest, pool)
        held: dict[int, tuple[object, np.ndarray]] = {}
        part, number, sequence, step = 0, 0, 0, 0
        key_type = pa.int64()

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence, step
            lengths = [sum(piece[0] for piece in window) for window in windows]
            groups = step_groups(lengths, step_windows * longest)
            found: list[tuple] = []
            for window, total, group in zip(windows, lengths, groups):
                offset = 0
                for length, document, start in window:
                    key, ids = held[document]
                    crc = zlib.crc32(ids[start : start + length])
                    place = (part << 33) + sequence
                    found.append((key, start, length, crc, len(ids), place, offset, total, (part << 33) + step + group))
                    offset += length
                sequence += 1
            step += max(groups, default=-1) + 1
            waiting = {document for _, document, _ in packer.waiting}
            for document in [document for document in held if document not in waiting]:
                del held[document]
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*found), [key_type] + [pa.int64()] * 8)]
            return pa.RecordBatch.from_arrays(arrays, names)

        full: list[list[Piece]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key_type = batch.column(0)[0].as_py(), batch.column(1).type
            for start, end, texts in text_slices(batch, "text"):
                keys = batch.column(1).slice(start, end - start).to_pylist()
                for key, ids in zip(keys, encode(texts)):
                    held[number] = (key, np.append(ids, np.uint32(end_id)).astype("<u4"))
                    full += packer.add(number, len(ids) + 1)
                    number += 1
                if len(packer.waiting) >= pool or len(full) >= pool:
                    full += packer.pack(last=False)
                    yield rows(full)
                    full = []
        full += packer.pack(last=True)
        if full:
            yield rows(full)

    shape = f"`{id_column}` {id_type}, " + ", ".join(f"{name} long" for name in names[1:])
    return columns.mapInArrow(pack, shape)
