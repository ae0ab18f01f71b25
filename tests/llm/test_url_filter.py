from __future__ import annotations

import random

import numpy as np

from ledgerloom.llm.queries import CORPUS_QUERIES, CORPUS_SQL, URL_RULES
from ledgerloom.llm import url_filter
from ledgerloom.llm.url_filter import Level, further_levels, is_listed, judge_urls
from tests.compare import differences, oracle
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
RULES = "host string, path string, verdict string"
URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.b.net/?q", "http://xnet/",
    "https://example.net/en/1", "https://example.net/en", "https://www.EXAMPLE.net/en/x#y", "ftp://example.com/de/", "http://example.com/fr/",
    "http://a.org/fr/", "http://org/fr/a://b", "http://a.org?/fr/", "http://user@net:80/", "x://y://net/", "http://.net/", "http://net./",
    "http://ÄÖ.net/é", "http://a\nb.net/x\ny", "http://" + "a." * 3000 + "net/" + "p" * 50_000,
]


def test_cascade_is_exact():
    draw = random.Random(1)
    universe = [str(draw.getrandbits(60)) for _ in range(20_000)]
    for count in (1, 50, 9000):
        pairs = brute.hash_pairs(universe)
        first = Level.of(pairs[:count], 0.3)
        passing = pairs[count:][first.passes(pairs[count:])]
        levels = further_levels([first], pairs[:count], passing)
        assert len(levels) > 1 and np.array_equal(is_listed(levels, pairs), np.arange(len(universe)) < count)


def test_rows(spark):
    rows = [(number, url) for number, url in enumerate(URLS)] + [(None, URLS[6]), (3, URLS[6])]
    df = brute.with_clashing(spark.createDataFrame(rows, "page_id long, url string"))
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("x", None, "block")], RULES)
    plain = {(host, path): verdict for host, path, verdict in URL_RULES}
    wanted = [(key, *brute.url_verdict(url, plain)) for key, url in rows]
    found = [tuple(row) for row in judge_urls(df, rules).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert judge_urls(df.limit(0), rules).collect() == []
    assert {row["verdict"] for row in judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def many_rules() -> tuple[dict, list]:
    draw = random.Random(2)
    hosts = [f"h{number}.example.{draw.choice(['com', 'net'])}" for number in range(400)]
    rules = {(host, draw.choice(["/", "/a/", ""])): draw.choice(["block", "allow"]) for host in hosts[:200]}
    rules |= {("com", "/b"): "block", ("EXAMPLE.net".lower(), "/"): "allow"}
    rows = [(number, f"http://{draw.choice(['', 'www.'])}{draw.choice(hosts)}{draw.choice(['', '/', '/a/x', '/b'])}") for number in range(800)]
    return rules, rows


def judged_rules(spark, **options) -> dict:
    rules, rows = many_rules()
    table = spark.createDataFrame([(host, path, verdict) for (host, path), verdict in rules.items()], RULES)
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), table, **options).collect()
    return {row["page_id"]: tuple(row)[1:] for row in found}


def test_many_rules(spark):
    rules, rows = many_rules()
    assert judged_rules(spark) == {key: brute.url_verdict(url, rules) for key, url in rows}


def test_long_lists_are_judged_in_parts(spark, monkeypatch):
    passes, judge = [], url_filter._judged
    monkeypatch.setattr(url_filter, "_judged", lambda *args: passes.append(args[3:]) or judge(*args))
    rules, rows = many_rules()
    assert judged_rules(spark, filter_bytes=24) == {key: brute.url_verdict(url, rules) for key, url in rows}
    assert len(passes) > 2 and passes == [(part, len(passes)) for part in range(len(passes))]


def test_levels_built_in_tasks_equal_those_of_the_driver(spark, monkeypatch):
    built, judge = [], url_filter._judged
    monkeypatch.setattr(url_filter, "_judged", lambda *args: built.append(args[1]) or judge(*args))
    whole = judged_rules(spark)
    monkeypatch.setattr(url_filter, "DRIVER_PAIRS", 0)
    monkeypatch.setattr(url_filter, "SEGMENT_BITS", 128)
    assert judged_rules(spark) == whole
    on_driver, in_tasks = built
    assert max(map(len, on_driver.values())) > 2 and on_driver.keys() == in_tasks.keys()
    for verdict, levels in on_driver.items():
        others = in_tasks[verdict]
        assert [(level.size, level.hashes, level.depth) for level in levels] == [(level.size, level.hashes, level.depth) for level in others]
        assert all(np.array_equal(level.bits, other.bits) for level, other in zip(levels, others))


def test_rules_that_fit_no_url(spark):
    rules = spark.createDataFrame([("exa", "mple", "block"), ("a/b", "", "block"), ("x", "", "allow"), ("y", "/b", "allow")], RULES)
    rows = [(1, "http://example"), (2, "http://a/b"), (3, "http://x/b")]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, default="none").collect()
    assert {row["page_id"]: (row["rule"], row["verdict"]) for row in found} == {1: (None, "none"), 2: (None, "none"), 3: ("x", "allow")}


def test_a_key_with_two_verdicts_blocks(spark):
    rules = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block")], RULES)
    df = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert judge_urls(df, rules).first()["verdict"] == "block"


def test_equals_sql(spark):
    name = "op7_url_filter"
    rows, found = differences(CORPUS_QUERIES[name](spark, FOLDER), oracle(FOLDER), CORPUS_SQL[name])
    assert rows > 0 and not found
