"""Repair of conversation structure with the fewest edits.

A conversation should read ``(s?(ua)+)?`` in role initials. Rows may be kept,
given another role, deleted, and empty rows inserted; a dynamic program over
four states finds the cheapest edits. It stores backward cost vectors only at
checkpoints, every square root of the rows, and computes the rows between two
checkpoints again while it walks forward and picks the ASCII-least edits.

Rows are sorted by range, so a conversation of any length is dealt to several
tasks. Its blocks of ``BLOCK_ROWS`` rows are checkpoints as well: a block is
summed up by the cost between any two states, the costs are chained backwards
per conversation, and then every block picks its edits on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, parts_for, total_bytes

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
TASK_BYTES = 64 << 20
# Repeated messages that are broadcast at most; more of them are joined by a shuffle.
REPEATS_BROADCAST = 200_000
# A message that one conversation repeats in more turns than this is never a shuffle key.
HOT_TURNS = 1 << 20

# States: nothing yet, after system, after user, after assistant.
_FREE = 1 << 50
_NEXT = (2, 2, 3, 2)
_NEXT_ROLE = ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_CLASSES = {"s": 0, "u": 1, "a": 2}
_KEPT_CLASS = tuple(tuple(to.get(initial, -1) for initial in ("s", "u", "a", "")) for to in _KEPT)
# A row's code: its role's class times four, plus 1 if it must go, 2 if it is cut off.
_GOES, _CUT = 1, 2
END = [0, 10, 5, 0]


def _closed(cost: list[int]) -> list[int]:
    """Costs with insertions in front."""
    start, system, user, assistant = cost
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(start, INSERT + user), min(system, INSERT + user), user, assistant]


def _before(code: int, after: list[int]) -> list[int]:
    """Costs in front of a row from those behind it."""
    cost = [DELETE + value for value in after]
    if not code & _GOES:
        extra = TRUNCATED if code & _CUT else 0
        for state in range(4):
            kept = _KEPT_CLASS[state][code >> 2]
            changed = REROLE + extra + after[_NEXT[state]]
            cost[state] = min(cost[state], changed, KEEP + extra + after[kept] if kept >= 0 else changed)
    return _closed(cost)


def _through(codes: bytes, after: list[int]) -> list[int]:
    for code in reversed(codes):
        after = _before(code, after)
    return after


def block_costs(codes: bytes) -> list[int]:
    """Least cost from each state in front of a block to each state behind it, row by row."""
    columns = [_through(codes, [0 if state == end else _FREE for state in range(4)]) for end in range(4)]
    return [min(columns[end][state], _FREE) for state in range(4) for end in range(4)]


def chained(costs: list[int], after: list[int]) -> list[int]:
    """Costs in front of a block whose ``block_costs`` are given."""
    return _closed([min(costs[4 * state + end] + after[end] for end in range(4)) for state in range(4)])


def tight_edits(codes: bytes, state: int, after: list[int]) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits from ``state`` and the state they end in.

    ``after`` holds the costs behind the last row. Insertions behind that row
    are left to what follows.
    """
    step = isqrt(len(codes)) + 1
    checkpoints = {len(codes): after}
    for start in range((len(codes) - 1) // step * step, -1, -step) if codes else ():
        end = min(start + step, len(codes))
        checkpoints[start] = _through(codes[start:end], checkpoints[end])
    edits = []
    for start in range(0, len(codes), step):
        end = min(start + step, len(codes))
        costs = [checkpoints[end]]
        for code in reversed(codes[start:end]):
            costs.append(_before(code, costs[-1]))
        costs.reverse()
        for at, code in enumerate(codes[start:end]):
            here, behind = costs[at], costs[at + 1]
            while True:
                left = here[state]
                if DELETE + behind[state] == left:
                    edits.append("D")
                    break
                if INSERT + here[_NEXT[state]] == left:
                    edits.append("I")
                    state = _NEXT[state]
                    continue
                kept = _KEPT_CLASS[state][code >> 2]
                extra = TRUNCATED if code & _CUT else 0
                if kept >= 0 and KEEP + extra + behind[kept] == left:
                    edits.append("K")
                    state = kept
                else:
                    edits.append("R")
                    state = _NEXT[state]
                break
    return "".join(edits), state


def closing_edits(state: int) -> tuple[str, int]:
    """Insertions behind the last row."""
    edits = ""
    while END[state]:
        edits += "I"
        state = _NEXT[state]
    return edits, state


def edited(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Messages, role and text, that the edits leave or make."""
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = _NEXT_ROLE[state]
        yield role, text
        state = _KEPT[state][role[:1]] if edit == "K" else _NEXT[state]


def edit_cost(edits: str, codes: bytes) -> int:
    cost, at = 0, 0
    for edit in edits:
        if edit == "I":
            cost += INSERT
            continue
        cost += {"D": DELETE, "K": KEEP, "R": REROLE}[edit] + (TRUNCATED if edit != "D" and codes[at] & _CUT else 0)
        at += 1
    return cost


class _Digest:
    """SHA-256 over messages that are joined by line ends."""

    def __init__(self) -> None:
        self.hash, self.joined = hashlib.sha256(), False

    def add(self, messages: Iterator[tuple[str, str]]) -> None:
        for role, text in messages:
            self.hash.update(f"{chr(10) if self.joined else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.joined = True


def damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows damaged by crc32(``conv:turn``) modulo 20, for tests and measurements of a repair.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes it a user's. Nulls count as one space. Returns ``conv``, ``turn``,
    ``role``, ``text`` and ``copies`` (1 or 2); a dropped row stays with null
    role and text, a null turn and no copies, so that its conversation is known.
    """
    space = F.lit(" ")
    known = lambda name: F.coalesce(F.col(name).cast("string"), space)
    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        known(role).alias("role"),
        known(text).alias("text"),
        (F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20).alias("harm"),
    )
    harm, stays = F.col("harm"), F.col("harm") != 0
    changed = F.when(harm == 1, F.lit("")).when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv",
        F.when(stays, F.col("turn")).alias("turn"),
        F.when(stays, F.when(harm == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        F.when(stays, changed).alias("text"),
        F.when(harm == 3, F.lit(2)).when(stays, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def _message(conv: Column, role: Column, text: Column) -> Column:
    """A key of a conversation's message; the lengths keep its parts apart."""
    name = F.coalesce(conv.cast("string"), F.lit(""))
    sizes = F.concat_ws(":", conv.isNull().cast("string"), F.length(name).cast("string"), F.length(role).cast("string"))
    return F.unhex(F.sha2(F.concat_ws(":", sizes, name, role, text), 256))


def _turn_order(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def _with_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row's first copy: 1 blank, 2 duplicate, 3 truncated, else 0.

    Only messages that a conversation holds in several turns are looked up.
    They are counted in a narrow pass; a message with very many turns has its
    first turn broadcast (there are at most rows / HOT_TURNS of them), the
    others are broadcast if few and joined by a shuffle if not.
    """
    keyed = rows.withColumn("message", F.when(F.col("copies") > 0, _message(F.col("conv"), F.col("role"), F.col("text"))))
    order = _turn_order()
    turns = (
        keyed.where("message is not null")
        .groupBy("message")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    repeats = checkpointed(turns.where(F.col("first") != F.col("last")).select("message", "first", "n"), "repeats")
    many = repeats.where(F.col("n") > HOT_TURNS).select(F.col("message").alias("hot"), F.col("first").alias("hot_first"))
    few = repeats.where(F.col("n") <= HOT_TURNS).select(F.col("message").alias("again"), F.col("first").alias("again_first"))
    merged = keyed.groupBy("conv", "turn", "role", "text", "message").agg(F.sum("copies").alias("copies"))
    marked = merged.join(F.broadcast(many), F.col("message") == F.col("hot"), "left")
    if repeats.count() <= REPEATS_BROADCAST:
        few = F.broadcast(few)
    # A hot message joins under a key of its own turn, which no other row has.
    own = F.when(F.col("hot").isNull(), F.col("message")).otherwise(F.unhex(F.sha2(F.col("turn").cast("string"), 256)))
    marked = marked.join(few, own == F.col("again"), "left")
    first = F.coalesce("hot_first", "again_first")
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = (
        F.when(bare == "", 1)
        .when(F.coalesce(order > first, F.lit(False)), 2)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    return marked.select("conv", "turn", "role", "text", "copies", F.coalesce(fault, F.lit(0)).alias("fault"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_LEGAL = {"su", "ua", "au"}
_BLOCK_SCHEMA = (
    "conv {conv}, part int, number long, whole boolean, codes binary, roles array<string>, texts array<string>, "
    "costs array<long>, least_turn long, most_turn long, turns long, n_rows long, first_initial string, "
    "last_initial string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.bytes = conv, bytearray(), [], [], 0
        self.least = self.most = None
        self.turns = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_initial = self.last_initial = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        if self.codes:
            self.counts["illegal"] += self.last_initial + initial not in _LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        if fault:
            self.counts[_COUNTS[fault - 1]] += 1
        goes = fault in (1, 2)
        self.codes.append(4 * _CLASSES.get(initial, 3) + (_GOES if goes else _CUT if fault == 3 else 0))
        # A row that must go needs no text.
        self.roles.append("" if goes else role)
        self.texts.append("" if goes else text)
        self.bytes += len(self.texts[-1]) + 64

    def full(self) -> bool:
        return len(self.codes) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def row(self, part: int, number: int, whole: bool) -> dict:
        codes = bytes(self.codes)
        row = {
            "conv": self.conv, "part": part, "number": number, "whole": whole, "least_turn": self.least,
            "most_turn": self.most, "turns": self.turns, "n_rows": len(codes), "first_initial": self.first_initial,
            "last_initial": self.last_initial, **self.counts,
        }
        if whole:
            edits, state = tight_edits(codes, 0, END)
            digest = _Digest()
            audit = edits + closing_edits(state)[0]
            digest.add(edited(audit, 0, zip(self.roles, self.texts)))
            return row | {"cost": edit_cost(audit, codes), "audit": audit, "repaired_sha256": digest.hash.hexdigest()}
        return row | {"codes": codes, "roles": self.roles, "texts": self.texts, "costs": block_costs(codes)}


def _blocks(schema: pa.Schema):
    """Sorted rows to blocks; a conversation that surely is whole in this task is finished at once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        block, only, first = None, True, True
        ready: list[dict] = []
        for batch in batches:
            for conv, turn, role, text, copies, fault in zip(*[column.to_pylist() for column in batch.columns]):
                if block is None or conv != block.conv:
                    if block is not None:
                        ready.append(block.row(part, number, only and not first))
                        number, first = number + 1, False
                    block, only = _Block(conv), True
                for copy in range(copies):
                    if block.full():
                        ready.append(block.row(part, number, False))
                        number, only = number + 1, False
                        block = _Block(conv)
                    block.add(turn, role, text, fault if not copy or fault == 1 else 2)
                if len(ready) >= 512 or ready and ready[-1].get("texts"):
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if block is not None:
            ready.append(block.row(part, number, False))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return build


_CHAIN_SCHEMA = "part int, number long, after array<long>, joints long, shared_turns long"


def _chain(blocks: pa.Table) -> pa.Table:
    """Costs behind each open block of one conversation, from the last block back."""
    rows = sorted(blocks.to_pylist(), key=lambda row: (row["part"], row["number"]))
    after, found = END, []
    for row in reversed(rows):
        found.append({"part": row["part"], "number": row["number"], "after": after, "joints": 0, "shared_turns": 0})
        after = chained(row["costs"], after)
    found.reverse()
    turn = initial = None
    for row, link in zip(rows, found):
        if row["least_turn"] is not None:
            link["shared_turns"] = int(row["least_turn"] == turn)
            turn = row["most_turn"]
        if row["n_rows"]:
            link["joints"] = int(initial is not None and initial + row["first_initial"] not in _LEGAL)
            initial = row["last_initial"]
    kinds = {"part": pa.int32(), "number": pa.int64(), "after": pa.list_(pa.int64()), "joints": pa.int64(), "shared_turns": pa.int64()}
    return pa.Table.from_pylist(found, pa.schema(list(kinds.items())))


def _with_choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each open block for every state that it may be entered in."""
    for batch in batches:
        codes, after = batch.column("codes").to_pylist(), batch.column("after").to_pylist()
        choices = [[tight_edits(block, state, behind) for state in range(4)] for block, behind in zip(codes, after)]
        edits = pa.array([[edit for edit, _ in own] for own in choices], pa.list_(pa.string()))
        exits = pa.array([[state for _, state in own] for own in choices], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, edits, exits], [*batch.schema.names, "edits", "exits"])


_RESULT = {
    "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
    "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}


def _walk(conv_type: pa.DataType):
    """Blocks of a conversation in order: one digest and one audit each, with one block in memory."""
    schema = pa.schema([("conv", conv_type), *_RESULT.items()])

    def finish(total: dict) -> dict:
        closing, _ = closing_edits(total["state"])
        total["digest"].add(edited(closing, total["state"], iter(())))
        turns = (total["least"], total["most"])
        row = {name: total[name] for name in ["conv", *_COUNTS]}
        return row | {
            "gaps": 0 if turns[0] is None else turns[1] - turns[0] + 1 - total["turns"],
            "cost": total["cost"] + INSERT * len(closing),
            "audit": "".join([*total["audit"], closing]),
            "repaired_sha256": total["digest"].hash.hexdigest(),
        }

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            done = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if total is None or total["conv"] != row["conv"]:
                    if total is not None:
                        done.append(finish(total))
                    total = {"conv": row["conv"], "state": 0, "least": None, "most": None, "turns": 0, "cost": 0, "audit": []}
                    total |= {"digest": _Digest()} | dict.fromkeys(_COUNTS, 0)
                edits, state = row["edits"][total["state"]], total["state"]
                total["digest"].add(edited(edits, state, zip(row["roles"], row["texts"])))
                total["cost"] += edit_cost(edits, row["codes"])
                total["audit"].append(edits)
                total["state"] = row["exits"][state]
                total["turns"] += row["turns"] - row["shared_turns"]
                if row["least_turn"] is not None:
                    total["least"] = row["least_turn"] if total["least"] is None else total["least"]
                    total["most"] = row["most_turn"]
                for name in _COUNTS:
                    total[name] += row[name]
                total["illegal"] += row["joints"]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if total is not None:
            yield pa.RecordBatch.from_pylist([finish(total)], schema)

    return walk


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and a digest of what they leave.

    Rows are taken by turn (nulls first), then role and text; equal rows follow
    each other. ``copies`` names a column with how often a row counts; none of
    a row without copies is left but the conversation's name. Null roles and
    texts count as one space, conversations with a null name are one
    conversation. Returns ``conv``, ``gaps`` (whole numbers missing between
    turns), ``blank``, ``duplicate``, ``truncated`` (each row's first fault),
    ``illegal`` (neighbouring role initials), ``cost``, ``audit`` (one letter an
    edit: Delete, Insert, Keep, Rerole) and ``repaired_sha256`` over the
    ``role:text`` left. An empty table gives no rows; other columns are not read.

    An audit and a digest belong to one conversation, so one task walks over its
    blocks, one at a time. All else of a long conversation is dealt to tasks.
    """
    space = F.lit(" ")
    known = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        *[F.coalesce(F.col(name).cast("string"), space).alias(as_) for name, as_ in ((role, "role"), (text, "text"))],
        (F.coalesce(F.col(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")).alias("copies"),
    )
    empty = F.col("copies") <= 0
    known = known.select(
        "conv",
        *[F.when(~empty, F.col(name)).alias(name) for name in ("turn", "role", "text")],
        F.greatest("copies", F.lit(0)).alias("copies"),
    )
    order = ["conv", "turn", "role", "text"]
    parts = parts_for(total_bytes(known, "text"), TASK_BYTES, rows.sparkSession.sparkContext.defaultParallelism)
    placed = _with_faults(known).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    conv_type = known.schema["conv"].dataType.simpleString()
    shape = _BLOCK_SCHEMA.format(conv=conv_type)
    arrow = _arrow_schema(rows, shape)
    blocks = checkpointed(placed.mapInArrow(_blocks(arrow), shape), "conversation-blocks")
    gap = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    result = ["conv", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    whole = blocks.where("whole").select("*", gap).select(*result)
    cut = blocks.where("not whole")
    chain = cut.select(
        "conv", "part", "number", "costs", "least_turn", "most_turn", "n_rows", "first_initial", "last_initial"
    )
    links = chain.groupBy("conv").applyInArrow(_chain, _CHAIN_SCHEMA)
    linked = cut.join(links, ["part", "number"]).select(
        "conv", "part", "number", "codes", "roles", "texts", "least_turn", "most_turn", "turns", *_COUNTS, "after", "joints", "shared_turns"
    )
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in linked.schema)
    chosen = linked.mapInArrow(_with_choices, f"{fields}, edits array<string>, exits array<int>")
    ordered = chosen.repartition("conv").sortWithinPartitions("conv", "part", "number")
    walked = ordered.mapInArrow(
        _walk(arrow.field("conv").type),
        f"conv {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string",
    )
    return whole.unionByName(walked.select(*result)).withColumnRenamed("conv", conv)


def _arrow_schema(df: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))
