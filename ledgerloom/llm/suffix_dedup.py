"""Removal of repeated byte strings by windows around triggers.

A trigger is a 28-byte string whose rolling 6-byte hashes are smallest at its
first or last place. Whether a string is a trigger depends on its bytes alone,
and every 49 bytes hold one, as in prefix-free parsing. To depth 50, a suffix of
the corpus is decided by at most 22 bytes before its first trigger, the trigger,
and at most 22 bytes behind it. These windows take the place of the dictionary of
phrases, the parse and their suffix arrays, none of which is built: there is no
corpus order, and nothing is compared beyond 50 bytes.

The job never gathers the corpus in one place:

1. Documents are dealt to blocks. A block lists its distinct triggers by bucket
   (a range of the trigger's hash), 4 bytes each.
2. A bucket tells the blocks which triggers occur in two documents or more.
   Texts around the others hold no repeated string of another document.
3. A block sends the distinct surroundings of the others to their bucket, with
   the smallest document that has them.
4. A bucket sorts what comes before a trigger (from it backwards) and, apart
   from that, the trigger with what follows. Neighbours in either order have
   common lengths; cut at depth d and 50 - d they give classes, and the entries
   in one pair of classes share 50 bytes. Their owner is the smallest document.
   A hot trigger would gather its surroundings in one bucket: a block sends its
   distinct strings of 50 bytes instead, dealt to all buckets by their hash.
5. A block marks the strings that a smaller document owns and cuts them out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import parts_for, total_bytes

LENGTH = 50
TRIGGER = 28
SEED = 6
SIDE = LENGTH - TRIGGER
WIDTH = TRIGGER + 2 * SIDE
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
# A block sends a row to every bucket, so both grow with the root of the corpus, up to this many times.
MOST_GROWTH = 32
# What one task of a shuffle reads, about.
TASK_BYTES = 64 << 20
# Triggers with more occurrences are hot: their strings are dealt to the buckets one by one.
ENTRY_LIMIT = 1 << 16
_STRIDE = 1 << 18
_TURN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.uint32(0x85EBCA77 ** (place + 1) % 2**32) for place in range(SEED)]
LAST = np.iinfo(np.int64).max


def _mix(words: Iterator[np.ndarray], seed: int) -> np.ndarray:
    total = np.uint64(seed)
    for word in words:
        total = (total ^ word) * _TURN
        total ^= total >> np.uint64(29)
    return total


def _triggers(text: np.ndarray) -> np.ndarray:
    """Places of all triggers in a buffer, slice by slice."""
    span = TRIGGER - SEED + 1
    found = []
    for start in range(0, max(0, len(text) - TRIGGER + 1), _STRIDE):
        codes = text[start : start + _STRIDE + TRIGGER - 1].astype(np.uint32)
        count = len(codes) - SEED + 1
        rolled = np.zeros(count, np.uint32)
        for place, factor in enumerate(_FACTORS):
            rolled += (codes[place : place + count] + np.uint32(1)) * factor
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x9E3779B1)
        least, width = rolled, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        ends = (rolled[: len(least)] == least) | (rolled[span - 1 : span - 1 + len(least)] == least)
        found.append(np.flatnonzero(ends) + start)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Block:
    """The documents of a block in order of their ids, parsed."""

    def __init__(self, table: pa.Table):
        known = pc.fill_null(table.column("id"), LAST).to_numpy().astype(np.int64)
        texts = pc.fill_null(table.column("text"), "").cast(pa.large_binary())
        order = np.argsort(known, kind="stable")
        self.table, self.order, self.ids = table, order, known[order]
        array = texts.combine_chunks().take(pa.array(order)) if table.num_rows else pa.array([], pa.large_binary())
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        offsets = np.zeros(1, np.int64)
        if len(array):
            offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
        size = int(offsets[-1] - offsets[0])
        # Room on both sides, so that surroundings never leave the buffer.
        self.text = np.zeros(size + WIDTH + LENGTH, np.uint8)
        if size:
            self.text[SIDE : SIDE + size] = np.frombuffer(array.buffers()[2], np.uint8, size, int(offsets[0]))
        self.begins = offsets[:-1] - offsets[0] + SIDE
        self.ends = offsets[1:] - offsets[0] + SIDE

    def parse(self) -> None:
        """``place``, ``doc``, ``left`` and ``right`` of the triggers that are the first of some 50 bytes."""
        places = _triggers(self.text[: self.ends[-1] if len(self.ends) else 0])
        doc = np.searchsorted(self.begins, places, "right") - 1
        # Empty documents share their place with the next; the last of them is the one that has bytes.
        whole = (doc >= 0) & (places + TRIGGER <= self.ends[np.maximum(doc, 0)])
        places, doc = places[whole], doc[whole]
        before = np.concatenate(([-1], places[:-1]))
        left = np.minimum(np.minimum(SIDE, places - before - 1), places - self.begins[doc])
        right = np.minimum(SIDE, self.ends[doc] - places - TRIGGER)
        used = left + right >= SIDE
        self.place, self.doc = places[used], doc[used]
        self.left, self.right = left[used].astype(np.uint8), right[used].astype(np.uint8)
        eights = np.lib.stride_tricks.as_strided(self.text, (len(self.text) - 7, 8), (1, 1))
        word = lambda shift: np.ascontiguousarray(eights[self.place + shift]).view(np.uint64).ravel()
        self.hash = _mix((word(shift) for shift in (0, 8, 16, TRIGGER - 8)), TRIGGER)
        # Distinct triggers in the order of their hash, and whether two documents of this block have one.
        by_hash = np.argsort(self.hash, kind="stable")
        ordered = self.hash[by_hash]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else by_hash
        self.known = ordered[first]
        self.times = np.diff(np.append(first, len(ordered)))
        self.which = np.empty(len(ordered), np.int64)
        self.which[by_hash] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ordered))))
        owner = self.ids[self.doc[by_hash]]
        self.several = (
            np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        )

    def buckets(self, count: int) -> Iterator[tuple[int, slice]]:
        """Bucket numbers with the range of ``known`` that falls into each."""
        bucket = ((self.known >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for start, stop in zip(cuts, np.append(cuts[1:], len(bucket))):
            yield int(bucket[start]), slice(int(start), int(stop))

    def surround(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Distinct surroundings of the shared triggers, in the order of the trigger's hash.

        ``rows`` are the occurrences, ``entry`` the surroundings of each,
        ``sides`` and ``first`` what an entry is made of: its bytes and lengths,
        and the smallest document that has it; ``hot`` are the entries of hot
        triggers.
        """
        rows = np.flatnonzero(shared[self.which])
        strips = np.lib.stride_tricks.as_strided(self.text, (len(self.text) - WIDTH + 1, WIDTH), (1, 1))
        sides = np.zeros((len(rows), WIDTH + 8), np.uint8)
        sides[:, :WIDTH] = strips[self.place[rows] - SIDE]
        left, right = self.left[rows], self.right[rows]
        for column in range(SIDE):
            sides[left < SIDE - column, column] = 0
            sides[right <= column, SIDE + TRIGGER + column] = 0
        sides[:, WIDTH], sides[:, WIDTH + 1] = left, right
        words = sides.view(np.uint64)
        signs = _mix((words[:, column] for column in range(words.shape[1])), WIDTH)
        order = np.lexsort((self.ids[self.doc[rows]], signs, self.which[rows]))
        sorted_signs, sorted_which = signs[order], self.which[rows][order]
        fresh = np.ones(len(rows), bool)
        if len(rows) > 1:
            alike = (sorted_signs[1:] == sorted_signs[:-1]) & (sorted_which[1:] == sorted_which[:-1])
            # Equal hashes are not trusted: rows that differ stay entries of their own.
            pairs = np.flatnonzero(alike)
            alike[pairs] = (words[order[pairs + 1]] == words[order[pairs]]).all(axis=1)
            fresh[1:] = ~alike
        firsts = order[fresh]
        self.rows = rows
        self.entry = np.empty(len(rows), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.sides = sides[firsts]
        self.first = self.ids[self.doc[rows[firsts]]]
        self.entry_trigger = self.which[rows[firsts]]
        self.hot = hot[self.entry_trigger]

    def split(self, count: int) -> None:
        """The distinct strings of 50 bytes of the hot entries, in an order that follows from them alone.

        ``strings`` and ``string_first`` are their bytes and smallest documents,
        ``string_bucket`` where they go, ``at_depth`` per depth the entries that
        have a string there and which. A string has its first trigger and depth
        from its bytes, so no two depths or triggers share one.
        """
        hot, total = np.flatnonzero(self.hot), 0
        left, right = self.sides[hot, WIDTH], self.sides[hot, WIDTH + 1].astype(np.int64)
        self.at_depth, strings, least = [], [np.zeros((0, LENGTH), np.uint8)], [np.zeros(0, np.int64)]
        for depth in range(SIDE + 1):
            own = hot[(depth <= left) & (depth >= SIDE - right)]
            if len(own):
                texts = self.sides[own, SIDE - depth : SIDE - depth + LENGTH]
                number, begins, order = _numbered(texts)
                self.at_depth.append((depth, own, number + total))
                strings.append(texts[order[begins]])
                least.append(np.minimum.reduceat(self.first[own[order]], begins))
                total += len(begins)
        self.strings, self.string_first = np.concatenate(strings), np.concatenate(least)
        padded = np.zeros((total, -(-LENGTH // 8) * 8), np.uint8)
        padded[:, :LENGTH] = self.strings
        words = padded.view(np.uint64)
        signs = _mix((words[:, column] for column in range(words.shape[1])), LENGTH)
        self.string_bucket = ((signs >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)

    def strings_by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """Bucket numbers with the numbers of the strings that go there."""
        order = np.argsort(self.string_bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.string_bucket[order], prepend=-1))
        for start, stop in zip(cuts, np.append(cuts[1:], len(order))):
            yield int(self.string_bucket[order[start]]), order[start:stop]

    def mark_hot(self, marks: np.ndarray, owned: np.ndarray) -> None:
        """Sets the marks of the hot entries; ``owned`` are the strings that a smaller document of any block has."""
        for depth, own, number in self.at_depth:
            gone = owned[number] | (self.string_first[number] < self.first[own])
            marks[own] |= gone.astype(np.uint32) << np.uint32(depth)

    def covered(self, marks: np.ndarray) -> np.ndarray:
        """Bytes covered by strings that a smaller document owns; ``marks`` has a bit per entry and depth."""
        starts = np.zeros(len(self.text) + 1, np.int32)
        place, left, right = self.place[self.rows], self.left[self.rows], self.right[self.rows]
        later = self.ids[self.doc[self.rows]] > self.first[self.entry]
        own = marks[self.entry]
        for depth in range(SIDE + 1):
            valid = (depth <= left) & (depth >= SIDE - right.astype(np.int64))
            gone = valid & (later | (own >> np.uint32(depth) & np.uint32(1) == 1))
            starts[place[gone] - depth + 1] = 1
        total = np.cumsum(starts)
        covered = total[1:].copy()
        covered[LENGTH:] -= total[1:-LENGTH]
        return covered > 0


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def _list_triggers(table: pa.Table, buckets: int) -> pa.Table:
    """Step 1: per bucket the distinct triggers of a block, and which of them two of its documents have."""
    block = Block(table)
    block.parse()
    rest = (block.known & np.uint64(0xFFFFFFFF)).astype("<u4")
    number = table.column("block")[0].as_py()
    packer = zstandard.ZstdCompressor(level=1)
    rows = [
        (
            bucket,
            number,
            rest[part].tobytes(),
            np.packbits(block.several[part]).tobytes(),
            packer.compress(block.times[part].astype("<u4").tobytes()),
        )
        for bucket, part in block.buckets(buckets)
    ]
    columns = list(zip(*rows)) or [[], [], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "triggers", "several", "times"]
    return pa.table([pa.array(values, kind) for values, kind in zip(columns, kinds)], names)


def _shared_triggers(table: pa.Table, entry_limit: int) -> pa.Table:
    """Step 2: for each block's list a bit per trigger, set if two documents have it, and the places of the hot ones."""
    unpacker = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(data, "<u4") for data in table.column("triggers").to_pylist()]
    sizes = [len(part) for part in parts]
    several = [_bits(data, size) for data, size in zip(table.column("several").to_pylist(), sizes)]
    values, marked = np.concatenate(parts), np.concatenate(several)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(begins, len(ordered)))
    shared = (counts > 1) | np.logical_or.reduceat(marked[order], begins)
    times = np.concatenate([np.frombuffer(unpacker.decompress(data), "<u4") for data in table.column("times").to_pylist()])
    hot = shared & (np.add.reduceat(times[order].astype(np.int64), begins) > entry_limit)
    bits, places = np.empty(len(values), bool), np.empty(len(values), bool)
    bits[order], places[order] = np.repeat(shared, counts), np.repeat(hot, counts)
    cuts = np.cumsum(sizes)[:-1]
    replies = [
        [np.packbits(part).tobytes() for part in np.split(bits, cuts)],
        [np.flatnonzero(part).astype("<u4").tobytes() for part in np.split(places, cuts)],
    ]
    columns = [table.column("block"), table.column("bucket"), *[pa.array(values, pa.binary()) for values in replies]]
    return pa.table(columns, ["block", "bucket", "shared", "hot"])


def _by_bucket(replies: pa.Table, name: str) -> dict[int, bytes]:
    return dict(zip(replies.column("bucket").to_pylist(), replies.column(name).to_pylist()))


def _known_shared(block: Block, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's triggers are shared, and which of these are hot."""
    shared_by, hot_by = _by_bucket(replies, "shared"), _by_bucket(replies, "hot")
    shared, hot = np.zeros(len(block.known), bool), np.zeros(len(block.known), bool)
    for bucket, part in block.buckets(buckets):
        if bucket in shared_by:
            shared[part] = _bits(shared_by[bucket], part.stop - part.start)
            hot[part.start + np.frombuffer(hot_by[bucket], "<u4").astype(np.int64)] = True
    return shared, hot


def _send_surroundings(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Step 3: per bucket the distinct surroundings of a block's shared triggers, and the distinct strings of the hot ones."""
    rows = []
    if table.num_rows:
        block = Block(table)
        block.parse()
        shared_by, hot_by = _by_bucket(replies, "shared"), _by_bucket(replies, "hot")
        block.surround(*_known_shared(block, replies, buckets))
        block.split(buckets)
        packer = zstandard.ZstdCompressor(level=1)
        pack = lambda values: packer.compress(np.ascontiguousarray(values).tobytes())
        number = table.column("block")[0].as_py()
        strings = dict(block.strings_by_bucket())
        parts = dict(block.buckets(buckets))
        for bucket in sorted({*parts, *strings}):
            part = parts.get(bucket, slice(0, 0))
            own = np.arange(*np.searchsorted(block.entry_trigger, [part.start, part.stop]).tolist())
            single = strings.get(bucket, np.zeros(0, np.int64))
            if len(own) or len(single):
                whole = own[~block.hot[own]]
                sides, first = pack(block.sides[whole, : WIDTH + 2]), pack(block.first[whole].astype("<i8"))
                alone, alone_first = pack(block.strings[single]), pack(block.string_first[single].astype("<i8"))
                rows.append((bucket, number, shared_by.get(bucket), hot_by.get(bucket), sides, first, alone, alone_first))
    columns = list(zip(*rows)) or [[] for _ in range(8)]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    names = ["bucket", "block", "shared", "hot", "sides", "first", "strings", "string_first"]
    return pa.table([pa.array(values, kind) for values, kind in zip(columns, kinds)], names)


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings (the rows), and what each has in common with the one before."""
    width = rows.shape[1]
    padded = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([words[:, column] for column in reversed(range(words.shape[1]))])
    ordered = rows[order]
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        odd = ordered[1:] != ordered[:-1]
        common[1:] = np.where(odd.any(axis=1), odd.argmax(axis=1), width)
    return order, common


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct byte strings in their order, and where each begins in the sorted order."""
    order, common = _order(rows)
    fresh = common < rows.shape[1]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, np.flatnonzero(fresh), order


def owners(sides: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Step 4: for each entry and depth the smallest document with the same 50 bytes.

    Depth ``d`` stands for the string that starts ``d`` bytes before the
    trigger. Two entries have the same one if they agree on the ``d`` bytes
    before the trigger, on the trigger and on the 22 - d bytes behind it.
    """
    count = len(sides)
    backward, ends = _order(sides[:, :SIDE][:, ::-1])
    forward, follows = _order(sides[:, SIDE:WIDTH])
    found = np.full((count, SIDE + 1), LAST)
    end_class, follow_class = np.empty(count, np.int64), np.empty(count, np.int64)
    for depth in range(SIDE + 1):
        rows = np.flatnonzero((depth <= left) & (depth >= SIDE - right.astype(np.int64)))
        if not len(rows):
            continue
        end_class[backward] = np.cumsum(ends < depth)
        follow_class[forward] = np.cumsum(follows < LENGTH - depth)
        run = follow_class[rows] * (count + 1) + end_class[rows]
        order = np.argsort(run, kind="stable")
        ordered = run[order]
        begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        least = np.minimum.reduceat(first[rows][order], begins)
        found[rows[order], depth] = np.repeat(least, np.diff(np.append(begins, len(ordered))))
    return found


def _mark(table: pa.Table) -> pa.Table:
    """Step 4 for a bucket: a bit per entry and depth, and one per string of a hot trigger, set if a smaller document owns it."""
    unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    read = lambda name, kind: [np.frombuffer(unpacker.decompress(data), kind) for data in table.column(name).to_pylist()]
    sides, first = read("sides", np.uint8), read("first", "<i8")
    marks = _entry_marks(np.concatenate(sides).reshape(-1, WIDTH + 2), np.concatenate(first))
    marks_of = np.split(marks, np.cumsum([len(part) for part in first])[:-1])
    strings, string_first = read("strings", np.uint8), read("string_first", "<i8")
    owned = _string_marks(np.concatenate(strings).reshape(-1, LENGTH), np.concatenate(string_first))
    owned_of = np.split(owned, np.cumsum([len(part) for part in string_first])[:-1])
    columns = [table.column(name) for name in ("block", "bucket", "shared", "hot")]
    columns.append(pa.array([packer.compress(part.astype("<u4").tobytes()) for part in marks_of], pa.binary()))
    columns.append(pa.array([np.packbits(part).tobytes() for part in owned_of], pa.binary()))
    return pa.table(columns, ["block", "bucket", "shared", "hot", "marks", "owned"])


def _string_marks(strings: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each string whether a smaller document has the same one."""
    if not len(strings):
        return np.zeros(0, bool)
    number, begins, order = _numbered(strings)
    return np.minimum.reduceat(first[order], begins)[number] < first


def _entry_marks(sides: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry a bit per depth, set if a smaller document has the same string."""
    if not len(sides):
        return np.zeros(0, np.uint32)
    left, right = sides[:, WIDTH], sides[:, WIDTH + 1]
    padded = np.zeros((len(sides), WIDTH + 8), np.uint8)
    padded[:, : WIDTH + 2] = sides
    words = padded.view(np.uint64)
    signs = _mix((words[:, column] for column in range(words.shape[1])), WIDTH)
    trigger = padded[:, SIDE : SIDE + TRIGGER + 4].copy()
    trigger[:, TRIGGER:] = 0
    trigger_words = trigger.view(np.uint64)
    trigger_signs = _mix((trigger_words[:, column] for column in range(4)), 1)
    # Equal surroundings of several blocks are one entry here.
    order = np.lexsort((signs, trigger_signs))
    fresh = np.ones(len(order), bool)
    alike = (signs[order][1:] == signs[order][:-1]) & (trigger_signs[order][1:] == trigger_signs[order][:-1])
    pairs = np.flatnonzero(alike)
    alike[pairs] = (words[order[pairs + 1]] == words[order[pairs]]).all(axis=1)
    fresh[1:] = ~alike
    begins = np.flatnonzero(fresh)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(first[order], begins)
    chosen = order[begins]
    # A trigger with one surrounding has one owner at every depth; only the others need the orders.
    group = np.cumsum(np.diff(trigger_signs[chosen], prepend=trigger_signs[chosen[0]]) != 0)
    several = np.bincount(group)[group] > 1
    marks = np.where(least[entry] < first, np.uint32((1 << SIDE + 1) - 1), np.uint32(0))
    sorted_out = np.flatnonzero(several)
    if len(sorted_out):
        some = chosen[sorted_out]
        found = owners(sides[some], left[some], right[some], least[sorted_out])
        number = np.full(len(chosen), -1)
        number[sorted_out] = np.arange(len(sorted_out))
        rows = np.flatnonzero(several[entry])
        own = number[entry[rows]]
        bits = np.zeros(len(rows), np.uint32)
        for depth in range(SIDE + 1):
            bits |= (found[own, depth] < first[rows]).astype(np.uint32) << np.uint32(depth)
        marks[rows] = bits
    return marks


def _whole_characters(text: np.ndarray, kept: np.ndarray) -> bytes:
    """The kept bytes without characters that lost some of theirs."""
    begins = np.flatnonzero((text & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(kept, begins) if len(begins) else np.zeros(0, bool)
    return text[np.repeat(whole, np.diff(np.append(begins, len(text))))].tobytes()


def _cut(table: pa.Table, replies: pa.Table, buckets: int, with_text: bool) -> pa.Table:
    """Step 5: every document of a block, with what is left of it."""
    block = Block(table)
    block.parse()
    marks_by, owned_by = _by_bucket(replies, "marks"), _by_bucket(replies, "owned")
    block.surround(*_known_shared(block, replies, buckets))
    block.split(buckets)
    marks = np.zeros(len(block.first), np.uint32)
    unpacker = zstandard.ZstdDecompressor()
    for bucket, part in block.buckets(buckets):
        own = slice(*np.searchsorted(block.entry_trigger, [part.start, part.stop]).tolist())
        if own.stop > own.start:
            whole = np.arange(own.start, own.stop)[~block.hot[own]]
            marks[whole] = np.frombuffer(unpacker.decompress(marks_by[bucket]), "<u4")
    owned = np.zeros(len(block.strings), bool)
    for bucket, numbers in block.strings_by_bucket():
        owned[numbers] = _bits(owned_by[bucket], len(numbers))
    block.mark_hot(marks, owned)
    gone = block.covered(marks)
    total = np.concatenate(([0], np.cumsum(gone)))
    removed = total[block.ends] - total[block.begins]
    rises = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
    spans = rises[block.ends] - rises[block.begins]
    # A run may reach the end of one document and go on at the start of the next: there it rises anew.
    joined = (block.begins < block.ends) & gone[block.begins] & gone[block.begins - 1]
    spans = spans + joined
    hashes, texts = [], []
    for begin, end, lost in zip(block.begins.tolist(), block.ends.tolist(), removed.tolist()):
        text, kept = block.text[begin:end], None
        if lost:
            kept = ~gone[begin:end]
            hashes.append(hashlib.sha256(text[kept]).hexdigest())
        else:
            hashes.append(hashlib.sha256(text).hexdigest())
        if with_text:
            texts.append((_whole_characters(text, kept) if lost else text.tobytes()).decode())
    rows = table.take(pa.array(block.order)).drop_columns(["block", "text"])
    values = {"n_bytes": block.ends - block.begins, "n_removed": removed, "n_spans": spans}
    for name, numbers in values.items():
        rows = rows.append_column(name, pa.array(numbers, pa.int64()))
    rows = rows.append_column("kept_sha256", pa.array(hashes, pa.string()))
    return rows.append_column("kept_text", pa.array(texts, pa.string())) if with_text else rows


def growth(size: int, block_bytes: int, bucket_bytes: int) -> float:
    """How many times larger blocks and buckets are than asked for.

    A pair of a block and a bucket costs a row of some hundred bytes. They stay
    a tenth of the corpus as long as a block times a bucket is a thousand times
    its size.
    """
    return min(MOST_GROWTH, max(1.0, math.sqrt(1000 * size / (block_bytes * bucket_bytes))))


def remove_repeats(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
    carried: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    entry_limit: int = ENTRY_LIMIT,
) -> DataFrame:
    """Cut out every byte covered by a 50-byte string that also starts in a document with a smaller id.

    Per row: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` of the remaining bytes; with ``with_text`` also
    ``kept_text``, where a character that lost some of its bytes goes as a
    whole. Overlapping strings count and are judged on the input, not on what is
    left; matches never cross documents. A null text counts as empty. Ids are
    whole numbers; rows with the same id never remove from each other, a null id
    counts as larger than any; an empty table gives no rows. The strings around
    a trigger with more than ``entry_limit`` occurrences are compared in all
    buckets, not in one. Of other columns only those in ``carried`` are read,
    whatever their names, and handed on under a struct ``carried``. Tasks,
    blocks and buckets are numbered by the bytes there are, see ``growth``.
    """
    chosen = [F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")]
    if carried:
        chosen.append(F.struct(*[F.col(f"`{name}`") for name in carried]).alias("carried"))
    rows = documents.select(*chosen)
    spark = documents.sparkSession
    size = total_bytes(rows, "text")
    larger = growth(size, block_bytes, bucket_bytes)
    blocks, buckets = parts_for(size, block_bytes * larger), parts_for(size, bucket_bytes * larger)
    # As many tasks as the bytes ask for, whatever the session's number is, so that none grows with the corpus.
    tasks = parts_for(size, TASK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(tasks, "block")
    listed = dealt.groupBy("block").applyInArrow(
        lambda table: _list_triggers(table, buckets), "bucket int, block int, triggers binary, several binary, times binary"
    )
    shared = listed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(
        lambda table: _shared_triggers(table, entry_limit), "block int, bucket int, shared binary, hot binary"
    )
    sent = dealt.groupBy("block").cogroup(shared.repartition(tasks, "block").groupBy("block")).applyInArrow(
        lambda table, replies: _send_surroundings(table, replies, buckets),
        "bucket int, block int, shared binary, hot binary, sides binary, first binary, strings binary, string_first binary",
    )
    marked = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(
        _mark, "block int, bucket int, shared binary, hot binary, marks binary, owned binary"
    )
    results = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    # The carried columns keep their own types, null or not.
    kept = [rows.schema[name] for name in ("id", "carried") if name in rows.columns]
    shape = StructType([*kept, *StructType.fromDDL(results)])
    cut = dealt.groupBy("block").cogroup(marked.repartition(tasks, "block").groupBy("block")).applyInArrow(
        lambda table, replies: _cut(table, replies, buckets, with_text), shape
    )
    return cut.withColumnRenamed("id", id_column)


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """All rows and columns of ``documents`` with the repeated strings cut out of their texts.

    A character that lost some of its bytes goes as a whole; ``length``, if
    there is such a column, is counted anew; a null text becomes an empty one.
    An empty table stays empty, null ids are treated as in ``remove_repeats``.
    """
    names = documents.columns
    carried = [name for name in names if name != text]
    cut = remove_repeats(documents, id_column, text, with_text=True, carried=carried, **options)
    new = {text: F.col("kept_text")}
    if length in names:
        new[length] = F.length("kept_text").cast(documents.schema[length].dataType)
    return cut.select(*[new.get(name, F.col("carried").getField(name)).alias(name) for name in names])
