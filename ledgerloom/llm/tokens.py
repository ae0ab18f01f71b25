"""Token ids of many texts, each distinct word encoded once per worker.

Merges never leave a word of the pre-tokenizer, so a text's ids are those of its
words in a row. Texts are cut into words with numpy, all texts of a slice at
once; a word is looked up by its bytes in a table of the words that the library
has encoded before.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

# Distinct words a worker remembers, some 60 bytes each. Beyond it the memory starts anew.
CACHED_WORDS = 1 << 20
_WORDS_AT_ONCE = 256
_KEY_BYTES = 24

# Texts of these characters only are cut into words here. Any other text goes to the library as a whole.
_ODD = re.compile("[^ \n\t!-~À-ÖØ-öø-ÿ]")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
# The patterns of the two kinds of tokenizer files whose words are cut here.
_LOWER_PATTERN = rf"{_SUFFIXES}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"

_END, _SPACE, _BREAK, _LETTER, _DIGIT, _MARK = range(6)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[0], _CLASS[32], _CLASS[[9, 10]] = _END, _SPACE, _BREAK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_MASKS = np.array([(1 << 8 * count) - 1 for count in range(9)], np.uint64)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def word_starts(data: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in texts that each end in a zero byte, and how long they are.

    ``byte``: a word takes the one space before it; other white space before a
    word is one word up to its last character, which is one by itself; digits
    stay together. ``lower``: no white space, digits alone. Both: an apostrophe
    at the start of a word makes a word with certain letters.
    """
    here = _CLASS[data]
    before = np.concatenate((np.zeros(1, np.uint8), here[:-1]))
    after = np.concatenate((here[1:], np.zeros(1, np.uint8)))
    start = here != before
    white = (here == _SPACE) | (here == _BREAK)
    if kind == "byte":
        start &= ~((before == _SPACE) & ~white & (here != _END))
        start[white] = False
        start |= white & (before != _SPACE) & (before != _BREAK)
        start |= white & (after >= _LETTER)
    else:
        start |= white | (here == _DIGIT)
    start |= here == _END
    quotes = np.flatnonzero((data == 39) & start)
    if len(quotes):
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        first, second = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        long = ((second == 101) & ((first == 114) | (first == 118))) | ((first == 108) & (second == 108))
        for found, size in ((quotes[short], 2), (quotes[long & ~short], 3)):
            start[found + 1] = False
            following = found + size
            start[following[here[following] == _LETTER]] = True
    places = np.flatnonzero(start)
    sizes = np.diff(np.append(places, len(data)))
    kept = here[places] != _END
    if kind == "lower":
        kept &= ~white[places]
    return places[kept], sizes[kept]


class WordEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = cached_words
        with open(path, encoding="utf-8") as file:
            self.kind = _kind(json.load(file))
        # An added token may stand anywhere in a text, so texts that may hold one go to the library.
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        # Tokens are written with one character a byte; a last one of a word may carry a mark.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        highest = max(vocabulary.values()) + 1
        self.token_bytes, self.word_end = np.zeros(highest, np.int64), np.zeros(highest, bool)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
            self.word_end[number] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys = np.zeros((1 << 11, _KEY_BYTES // 8), np.uint64)
        self.long: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 11, np.int32), np.zeros(1 << 11, np.int32)
        self.count = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        plain = [
            self.kind is not None and not _ODD.search(text) and not (self.added and self.added.search(text))
            for text in texts
        ]
        others = [text for text, is_plain in zip(texts, plain) if not is_plain]
        odd = iter(self.tokenizer.encode_batch(others, add_special_tokens=False) if others else [])
        even = iter(self._plain([text for text, is_plain in zip(texts, plain) if is_plain]))
        return [next(even) if is_plain else np.array(next(odd).ids, np.uint32) for is_plain in plain]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.count > self.limit:
            self._forget()
        joined = "".join(f"{text}\0" for text in texts)
        data = (joined if self.kind == "byte" else joined.lower()).encode()
        buffer = np.frombuffer(data + b"\0" * _KEY_BYTES, np.uint8)
        places, sizes = word_starts(buffer[: len(data)], self.kind)
        numbers = self._numbers(data, buffer, places, sizes)
        lengths = self.size[numbers].astype(np.int64)
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(self.begin[numbers] - (stops - lengths), lengths) + np.arange(total)]
        words_before = np.searchsorted(places, np.flatnonzero(buffer[: len(data)] == 0))
        cuts = np.concatenate(([0], stops))[words_before].tolist()
        return [ids[start:stop] for start, stop in zip([0, *cuts], cuts)]

    def _numbers(self, data: bytes, buffer: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each word; words met for the first time are encoded."""
        eights = np.lib.stride_tricks.as_strided(buffer, (len(buffer) - 7, 8), (1, 1))
        keys = np.empty((len(places), _KEY_BYTES // 8), np.uint64)
        for column in range(keys.shape[1]):
            shift = 8 * column
            # A short word at the end of the buffer has no bytes there.
            word = eights[np.minimum(places + shift, len(eights) - 1)].view(np.uint64).ravel()
            keys[:, column] = word & _MASKS[np.clip(sizes - shift, 0, 8)]
        numbers = self._find(keys)
        big = np.flatnonzero(sizes > _KEY_BYTES)
        for place in big.tolist():
            numbers[place] = self.long.get(data[places[place] : places[place] + sizes[place]], -1)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            words = [data[start : start + size] for start, size in zip(places[unknown].tolist(), sizes[unknown].tolist())]
            entry = {word: at for at, word in enumerate(dict.fromkeys(words))}
            entry = {word: self.count + at for at, word in enumerate(self._learn(list(entry)))}
            numbers[unknown] = [entry[word] for word in words]
            # The first place of each new word gives its key.
            new, first = np.unique(numbers[unknown], return_index=True)
            short = sizes[unknown[first]] <= _KEY_BYTES
            self._keep(new, keys[unknown[first]], short)
            self.long.update((words[at], int(number)) for at, number in zip(first[~short].tolist(), new[~short]))
            self.count += len(entry)
        return numbers

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        total = keys[:, 0] * _TURN
        for column in range(1, keys.shape[1]):
            total = ((total ^ (total >> np.uint64(29))) + keys[:, column]) * _TURN
        return total >> np.uint64(32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = (self._hash(keys) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys).any(axis=1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[slot[wrong]]
            own = found[wrong]
            wrong = wrong[(own >= 0) & (self.keys[own] != keys[wrong]).any(axis=1)]
        return found.astype(np.int64)

    def _keep(self, numbers: np.ndarray, keys: np.ndarray, short: np.ndarray) -> None:
        needed = int(numbers[-1]) + 1
        while needed > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.keys[numbers] = keys

        if 2 * needed > len(self.slots):
            size = len(self.slots)
            while 2 * needed > size:
                size *= 4
            kept = self.slots[self.slots >= 0].astype(np.int64)
            self.slots = np.full(size, -1, np.int32)
            self._place(kept)
        self._place(numbers[short])

    def _place(self, numbers: np.ndarray) -> None:
        slot = (self._hash(self.keys[numbers]) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            waiting = self.slots[slot] != numbers
            numbers, slot = numbers[waiting], (slot[waiting] + 1) & (len(self.slots) - 1)

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Encode new words and append their ids; returns them in the order of their entries.

        Words that a space parts are encoded many at a time, the others one by one.
        """
        joined, rest, glue = words, [], b" "
        if self.kind == "byte":
            parts: tuple[list[bytes], list[bytes]] = ([], [])
            for word in words:
                parts[word[:1] != b" " or len(word) == 1 or word[1] in b" \n\t"].append(word)
            (joined, rest), glue = parts, b""
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if joined:
            chunks = [
                glue.join(joined[start : start + _WORDS_AT_ONCE]).decode()
                for start in range(0, len(joined), _WORDS_AT_ONCE)
            ]
            found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(encoding.ids for encoding in found), np.uint32)
            ends = np.flatnonzero(self._closes(ids, joined)) + 1
            if len(ends) != len(joined) or ends[-1] != len(ids):
                raise ValueError("the tokenizer parts words otherwise than its file says")
            sizes = np.diff(ends, prepend=0)
        alone = self.tokenizer.encode_batch([word.decode() for word in rest], add_special_tokens=False) if rest else []
        lists = [encoding.ids for encoding in alone]
        new = np.concatenate([ids, *(np.array(own, np.uint32) for own in lists)])
        sizes = np.concatenate([sizes, np.array([len(own) for own in lists], np.int64)])
        first, last = self.count, self.count + len(words)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while last > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(new)] = new
        self.begin[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.used += len(new)
        return joined + rest

    def _closes(self, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Which of the ids of words in a row end a word."""
        if self.kind == "lower":
            return self.word_end[ids]
        # Each of these words holds one space, its first byte.
        begins = np.append(np.frombuffer(b"".join(words), np.uint8) == 32, True)
        return begins[np.cumsum(self.token_bytes[ids])]


def _kind(spec: dict) -> str | None:
    """Which of the two word patterns a tokenizer file asks for, if either."""
    before, shape = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"].get("dropout") or spec["model"]["type"] != "BPE":
        return None
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not shape:
        return "byte"
    steps = [step["type"] for step in shape.get("normalizers", [])]
    inner = before.get("pretokenizers", [{}])
    pattern = inner[0].get("pattern", {}).get("Regex")
    if steps == ["NFC", "Replace", "Lowercase"] and pattern == _LOWER_PATTERN and [step["type"] for step in inner] == ["Split", "ByteLevel"]:
        return "lower"
    return None


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
