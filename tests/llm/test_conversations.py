from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerloom.llm import conversations
from ledgerloom.llm.conversations import END, block_costs, chained, closing_edits, damaged, edit_cost, edited, repair, tight_edits
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"
SHAPE = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if value is None else value for value in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            row = (conv, turn, "user" if harm == 4 else role, text)
            yield from [row] * (2 if harm == 3 else 1)


def plain_edits(rows):
    """All cheapest edits by a table of whole audits; ``rows``: role, text, fault."""
    best = {0: (0, "", ())}

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def step(table, options):
        made = {}
        for state, entry in table.items():
            for to, cost, letter, message in options(state):
                better(made, to, (entry[0] + cost, entry[1] + letter, entry[2] + message))
        return made

    follow = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(table):
        for _ in range(4):
            for state, entry in list(table.items()):
                to, role = follow[state]
                better(table, to, (entry[0] + 5, entry[1] + "I", entry[2] + ((role, ""),)))
        return table

    for role, text, fault in rows:

        def options(state, role=role, text=text, fault=fault):
            yield state, 2, "D", ()
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] in kept[state]:
                    yield kept[state][role[:1]], extra, "K", ((role, text),)
                to, other = follow[state]
                yield to, 1 + extra, "R", ((other, text),)

        best = step(inserted(best), options)
    best = inserted(best)
    return min(best[state] for state in (0, 3) if state in best)


def plain_repair(rows):
    result = []
    groups = {}
    for row in rows:
        groups.setdefault(row[0], [])
    for row in plain_damage(rows):
        groups[row[0]].append(row)
    for conv, own in groups.items():
        own.sort(key=lambda row: (row[1] is not None, row[1] or 0, row[2].encode(), row[3].encode()))
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                counts[fault] += 1
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = {row[1] for row in own if row[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, messages = plain_edits([(row[2], row[3], fault) for row, fault in zip(own, faults)])
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in messages).encode()).hexdigest()
        result.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(result, key=repr)


def check(spark, rows):
    df = brute.with_clashing(spark.createDataFrame(rows, SHAPE))
    found = repair(damaged(df), "conv", copies="copies").withColumnRenamed("conv", "conv_id")
    assert found.columns == COLUMNS
    assert sorted((tuple(row) for row in found.collect()), key=repr) == plain_repair(rows)


def test_whole_table(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_random_long_conversations(spark, monkeypatch, block_rows):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block_rows)
    draw = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Well. ", "x ", "é?", ".", None]
    roles = ["user", "assistant", "system", "usher", "tool", "", None]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.choice([0, 1, 2, 5, 9, 40])):
            text = draw.choice(texts) if draw.random() < 0.4 else f"text {draw.randrange(30)}."
            rows.append((conv, draw.choice([turn, turn, turn + 3, None, 7]), draw.choices(roles, [9, 9, 2, 1, 1, 1, 1])[0], text))
    rows += rows[:50]
    check(spark, rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 16)
    monkeypatch.setattr(conversations, "HOT_TURNS", 50)
    monkeypatch.setattr(conversations, "REPEATS_BROADCAST", 0)
    draw = random.Random(6)
    rows = [(1, turn, draw.choice(["user", "assistant"]), draw.choice(["Same again.", f"Turn {turn}.", f"Turn {turn // 9}", "Ha!"])) for turn in range(600)]
    rows += [(2 + turn // 4, turn % 4, draw.choice(["user", "assistant", "system"]), "Same again.") for turn in range(400)]
    check(spark, rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert repair(damaged(empty), "conv", copies="copies").collect() == []
    rows = [(None, None, None, None), (None, None, None, None), (4, 1, "user", "Long. " * 200_000), (4, 2, "assistant", "."), (4, 2, "assistant", ".")]
    check(spark, rows)
    alone = next(key for key in range(1000) if zlib.crc32(f"{key}:0".encode()) % 20 == 0)
    check(spark, [(alone, 0, "user", "Gone.")])


def test_blocks_agree_with_the_whole():
    draw = random.Random(7)
    for _ in range(200):
        codes = bytes(draw.choice([0, 4, 4, 8, 8, 12, 1, 5, 6, 10]) for _ in range(draw.randrange(40)))
        edits, state = tight_edits(codes, 0, END)
        whole = edits + closing_edits(state)[0]
        cut = draw.randrange(len(codes) + 1)
        behind = chained(block_costs(codes[cut:]), END)
        first, state = tight_edits(codes[:cut], 0, behind)
        second, state = tight_edits(codes[cut:], state, END)
        assert first + second + closing_edits(state)[0] == whole
        assert edit_cost(whole, codes) == chained(block_costs(codes), END)[0]
        left = "".join(role[0] for role, _ in edited(whole, 0, iter([("suat"[code >> 2], "") for code in codes])))
        assert re.fullmatch("(s?(ua)+)?", left)
