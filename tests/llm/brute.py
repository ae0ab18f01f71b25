"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import xxhash
import zstandard

UPPER = {code: code + 32 for code in range(65, 91)}
CLASHING = ["id", "row", "block", "fp", "words", "hashes", "part", "start", "n_tokens", "score", "hash", "carried", "key", "page"]


def with_clashing(df):
    """The same rows with further columns, named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(name) for name in CLASHING if name not in df.columns})


def repeats(rows, length=50):
    owner = {}
    for key, text in rows:
        data = (text or "").encode()
        for place in range(len(data) - length + 1):
            gram = data[place : place + length]
            owner[gram] = min(owner.get(gram, key), key)
    result = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for place in range(len(data) - length + 1):
            if owner[data[place : place + length]] < key:
                gone[place : place + length] = [True] * length
        spans = sum(now and not before for before, now in zip([False, *gone], gone))
        kept = bytes(byte for byte, lost in zip(data, gone) if not lost)
        result.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result)


def contamination(rows, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))

    grams = defaultdict(set)
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for start in range(len(own) - size + 1 if own else 0):
            grams[tuple(own[start : start + size])].add(item)
    result = []
    for key, text in rows:
        own, hit, found = words(text), set(), set()
        for size in {len(gram) for gram in grams}:
            for start in range(len(own) - size + 1):
                if (gram := tuple(own[start : start + size])) in grams:
                    hit.update(range(start, start + size))
                    found |= grams[gram]
        named = sorted(str(item) for item in found if item is not None)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        result.append((key, len(own), len(hit), len(named), digest, bool(hit)))
    return result


def fingerprint(text, shingle=3):
    words = [word.decode() for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(UPPER).encode())]
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[at : at + size]).encode(), 42) for at in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def groups(values, linked):
    """Members of each connected group, by index."""
    group = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if group[a] != group[b] and linked(values[a], values[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if member == old else member for member in group]
    return group


def hash_pairs(keys):
    """The two 64-bit hashes of each key that a filter takes its places from."""
    data = [key.encode() for key in keys]
    pairs = [(xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key + b"#", 42)) for key in data]
    return np.array(pairs, np.uint64).reshape(-1, 2)


def url_verdict(url, rules):
    """host, path, rule, verdict; ``rules`` maps (host, path) to a verdict."""
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(UPPER), slash + path
    fits = [
        (len(name + start), name, start)
        for name, start in rules
        if (host == name or host.endswith("." + name)) and path.startswith(start)
    ]
    if not fits:
        return host, path, None, "allow"
    _, name, start = max(fits)
    return host, path, name + start, rules[name, start]


def quality(text, good, bad, centre, spread, weights):
    """Score by the sizes that zstandard itself gives with either dictionary."""
    sizes = []
    for dictionary in (good, bad):
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False
        )
        sizes.append(len(packer.compress(text)) / (len(text) + 32))
    gap, share, log = sizes[0] - sizes[1], (sizes[0] - sizes[1]) / sum(sizes), math.log(len(text) + 32)
    base = [gap, share, *sizes, log]
    mixed = [abs(gap), gap * sizes[0], share * sizes[1], share * log, sizes[0] * log]
    total = weights[-1]
    for value, middle, wide, weight in zip([*base, *[each**2 for each in base], *mixed], centre, spread, weights):
        total += min(12, max(-12, (value - middle) / wide)) * weight
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def toxicity(text, weights, bias, scale, shift):
    """Worst window of eight words or so, word by word and n-gram by n-gram."""
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower().replace("\x00", " "))
    words = [word for at, word in enumerate(words) if not at or word != words[at - 1]]
    averages = []
    for word in words:
        # A word is opened and closed by a mark, a word without any n-gram of three to six counts as nothing.
        codes = [0, *map(ord, word), 0]
        rows = []
        for length in range(3, 7):
            for start in range(len(codes) - length + 1):
                value = sum((code + 1) * pow(0x85EBCA77, place + 1, 2**32) for place, code in enumerate(codes[start : start + length])) % 2**32
                value = (value ^ value >> 15) * 0x9E3779B1 % 2**32
                rows.append(value >> 32 - 18)
        averages.append(sum(weights[row] for row in rows) / max(1, len(rows)))
    windows = max(1, -(-len(words) // 8))
    sums, sizes = [0.0] * windows, [0] * windows
    for rank, average in enumerate(averages):
        window = rank * windows // len(words)
        sums[window] += average
        sizes[window] += 1
    worst = max(total / max(1, size) + bias for total, size in zip(sums, sizes))
    return 1 / (1 + math.exp(-min(30, max(-30, scale * worst + shift))))
