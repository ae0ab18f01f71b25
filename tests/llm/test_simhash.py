from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import fingerprint, fingerprint_links, near_duplicates, position_sets, without_near_duplicates
from tests.llm import brute


def test_fingerprint_by_its_definition(monkeypatch):
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 7)
    draw = random.Random(1)
    texts = ["", " \t\n", "one", "One two", "a b c", "É é A\x0bB\x1cC d e", "x " * 500]
    texts += [" ".join(draw.choice(["the", "of", "a", "b"]) for _ in range(40)) for _ in range(10)]
    assert [fingerprint(text) for text in texts] == [brute.fingerprint(text) for text in texts]


@pytest.mark.parametrize("width", [3, 4, 5])
def test_any_five_positions_hold_a_set(width):
    from itertools import combinations

    sets = position_sets(width, 5)
    assert all(any(set(some) <= set(five) for some in sets) for five in combinations(range(8), 5))


def clusters(seed=5):
    draw, values = random.Random(seed), {0, 2**64 - 1}
    for _ in range(25):
        centre = draw.getrandbits(64)
        for _ in range(40):
            value = centre
            for _ in range(draw.randint(0, 5)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    return sorted(values)


@pytest.mark.parametrize("limit, width", [(4096, 3), (6, 3), (4096, 4), (4096, 5)])
def test_links_connect_all_groups(spark, limit, width):
    values = clusters()
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(value,) for value in signed], "fp long")
    links = fingerprint_links(df, list_limit=limit, width=width)
    roots = {row["node"]: row["root"] for row in components(links).collect()}
    found = [roots.get(value, value) for value in signed]
    wanted = brute.groups(values, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = lambda names: {frozenset(at for at, other in enumerate(names) if other == name) for name in names}
    assert pairs(found) == pairs(wanted)


def test_split_lists_keep_all_links(spark):
    # 256 centres over two bytes a position, each with fingerprints that differ from it in three different
    # bytes: most sets of five positions hold several of the long base lists.
    draw, values = random.Random(3), {}
    for number in range(256):
        centre = sum(0xF0 << 8 * place for place in range(8) if number >> place & 1)
        values[centre] = number
        for _ in range(14):
            bits = [8 * place + draw.randrange(4) for place in draw.sample(range(8), 3)]
            values[centre ^ sum(1 << bit for bit in bits)] = number
    fps = np.array(sorted(values), np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps) <= 3
    wanted, before = np.arange(len(fps)), None
    while not np.array_equal(wanted, before):
        wanted, before = np.where(close, wanted, len(fps)).min(1), wanted
    df = spark.createDataFrame([(value,) for value in fps.view(np.int64).tolist()], "fp long")
    links = fingerprint_links(df, list_limit=40)
    place = {value: at for at, value in enumerate(fps.view(np.int64).tolist())}
    assert all(close[place[row["a"]], place[row["b"]]] for row in links.collect())
    roots = {row["node"]: row["root"] for row in components(links).collect()}
    pairs = lambda names: {frozenset(at for at, other in enumerate(names) if other == name) for name in set(names)}
    assert len(fps) > 3000 and pairs([roots.get(value, value) for value in place]) == pairs(wanted.tolist())


def test_a_list_that_is_not_whole_fails(spark):
    rows = spark.createDataFrame([(7, 1, 1, 3), (7, 1, 3, 3)], "positions long, bytes long, fp long, size long")
    with pytest.raises(Exception, match="not whole"):
        simhash._links(rows, 5, 3).collect()


def test_lists_over_many_batches(spark):
    values = np.unique(np.random.default_rng(4).integers(0, 1 << 20, 400)) << 24
    df = spark.createDataFrame([(value,) for value in values.tolist()], "fp long")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    found = []
    for rows in ("3", "50", before):
        spark.conf.set(batch, rows)
        found.append({tuple(row) for row in fingerprint_links(df).collect()})
    spark.conf.set(batch, before)
    assert found[0] and found[0] == found[1] == found[2]


def test_rounds_are_removed(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    tables = lambda: {path.name for path in root.glob("*") if path.name.startswith(("links-", "roots-"))}
    before = tables()
    found = components(spark.createDataFrame([(number, number + 1) for number in range(20)], "a long, b long"))
    assert found.count() == 21 and len(tables() - before) == 1


def test_probes_find_what_tiles_find():
    draw = np.random.default_rng(2)
    values = np.unique(draw.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(40) | np.uint64(0x77))
    as_set = lambda pairs: {tuple(sorted((a, b))) for first, second in pairs for a, b in zip(first.tolist(), second.tolist())}
    assert as_set(simhash._tiles(values, 5, 3)) == as_set(simhash._probes(values, 0b00011111, 3))
    members = len(values)
    assert len(simhash._forest(members, simhash._tiles(values, 5, 3))) < members


def rows_of():
    draw = random.Random(9)
    base = [" ".join(draw.choice(["alpha", "beta", "of", "the", "x1"]) + str(draw.randint(0, 40)) for _ in range(120)) for _ in range(12)]
    rows = []
    for number in range(90):
        words = draw.choice(base).split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "new"
        rows.append((number, " ".join(words)))
    return rows + [(200, None), (201, ""), (202, " \n"), (None, base[0]), (None, None), (5, "other words here"), (5, "other words here"), (300, "w " * 50_000)]


def test_components_of_documents(spark):
    rows = rows_of()
    df = brute.with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = [brute.fingerprint(text) for _, text in rows]
    group = brute.groups(marks, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {name: min((rows[at][0] for at, own in enumerate(group) if own == name and rows[at][0] is not None), default=None) for name in group}
    wanted = [(key, f"{mark:016x}", least[name]) for (key, _), mark, name in zip(rows, marks, group)]
    found = [tuple(row) for row in near_duplicates(df).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert near_duplicates(df.limit(0)).collect() == []
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(group))
    assert {row["doc_id"] for row in kept.collect()} == {key for key in least.values()}


def test_long_chains_and_hubs(spark):
    chain = [(number, number + 1) for number in range(60)] + [(1000, number) for number in range(1001, 1200)]
    roots = {row["node"]: row["root"] for row in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[number] for number in range(61)} == {0} and {roots[number] for number in range(1000, 1200)} == {1000}
