"""Toxicity scores from bags of character n-gram vectors.

A word is the average of the vectors of its character n-grams (hashed into a
fixed table), a window of words the average of its words, and a linear softmax
over that average gives the probability. Vectors and softmax are trained jointly
in numpy, so a misspelling never seen scores by the n-grams it shares with known
words. A document has the probability of its worst window: a few words must
weigh as much in a long document as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices
from ledgerloom.llm.labelled import labelled_sample, remainder

PER_CLASS = 1500
MAX_CHARS = 6_000
WINDOW_WORDS = 8
TABLE_BITS = 18
DIMENSIONS = 8
BATCHES = 8
EPOCHS = 16
ROUNDS = 5
RATE = 100.0
COLUMN_NORM = 30.0
SLICE = 1 << 18
SHORTEST, LONGEST = 3, 6
_TURN = np.uint32(0x9E3779B1)
_FACTORS = [np.uint32(0x85EBCA77 ** (place + 1) % 2**32) for place in range(LONGEST)]


@dataclass
class Bags:
    """The n-grams of some texts: table row and word of each, and how words fill windows and windows texts."""

    gram: np.ndarray
    word: np.ndarray
    word_window: np.ndarray
    window_text: np.ndarray

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Window averages of word averages of a number that each table row has."""
        words = len(self.word_window)
        sums = np.bincount(self.word, weights[self.gram], words)
        each = np.bincount(self.word, minlength=words)
        windows = len(self.window_text)
        sizes = np.maximum(np.bincount(self.word_window, minlength=windows), 1)
        return np.bincount(self.word_window, sums / np.maximum(each, 1), windows) / sizes


def _same(codes: np.ndarray, marks: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For the words that may equal the one before them, whether they do, letter by letter."""
    later = np.flatnonzero(pairs) + 1
    sizes = lengths[later].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    letter = np.arange(sizes.sum()) - np.repeat(first, sizes)
    equal = codes[np.repeat(marks[later], sizes) + letter] == codes[np.repeat(marks[later - 1], sizes) + letter]
    same = np.zeros(len(pairs), bool)
    if len(later):
        same[later - 1] = np.logical_and.reduceat(equal, first)
    return same


def bags(texts: list[str]) -> Bags:
    """N-grams of the words (runs of letters, digits and non-ASCII characters) of lower-cased texts.

    A word that only repeats the one before it, letter by letter, is left out,
    or a junk text that repeats one word would be judged by that word alone.
    """
    joined = "".join(" " + text.lower().replace("\x00", " ") + "\x00" for text in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    part = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128)
    ends = np.flatnonzero(codes == 0)
    # One mark before each word is kept, and one at the end.
    keep = part.copy()
    keep[:-1] |= part[1:]
    keep[-1] = True
    places = np.flatnonzero(keep)
    part, codes = part[places], np.where(part[places], codes[places], 0).astype(np.uint32)
    marks = np.flatnonzero(~part).astype(np.int32)
    lengths = np.diff(marks)
    in_text = np.searchsorted(ends, places[marks[:-1]])
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rest = np.repeat(marks[1:], lengths) - np.arange(len(word), dtype=np.int32)
    if len(word):
        odd = (2 * (lengths.max() + 1 - rest) + 1).astype(np.uint32) * np.uint32(0x85EBCA6B)
        signs = np.add.reduceat((codes[:-1] ^ (codes[:-1] << np.uint32(13))) * odd, marks[:-1])
        again = (signs[1:] == signs[:-1]) & (lengths[1:] == lengths[:-1]) & (in_text[1:] == in_text[:-1])
        again &= _same(codes, marks, lengths, again)
        fresh = np.concatenate(([True], ~again))
        number = np.cumsum(fresh, dtype=np.int32) - 1
        rest = np.where(fresh[word], rest, 0)
        word, in_text = number[word], in_text[fresh]
    grams, words = [], []
    rolled = np.zeros(len(codes), np.uint32)
    for length in range(1, LONGEST + 1):
        count = len(codes) - length + 1
        if count <= 0:
            break
        rolled = rolled[:count] + (codes[length - 1 :] + np.uint32(1)) * _FACTORS[length - 1]
        if length >= SHORTEST:
            # A word is closed by the mark of the next one, at ``rest`` positions from here.
            fits = np.flatnonzero(rest[:count] >= length - 1)
            mixed = rolled[fits]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * _TURN
            grams.append((mixed >> np.uint32(32 - TABLE_BITS)).astype(np.int32))
            words.append(word[fits])
    per_text = np.bincount(in_text, minlength=len(texts))
    windows = np.maximum(1, -(-per_text // WINDOW_WORDS))
    rank = np.arange(len(in_text)) - (np.cumsum(per_text) - per_text)[in_text]
    window = (np.cumsum(windows) - windows)[in_text] + rank * windows[in_text] // np.maximum(per_text[in_text], 1)
    return Bags(
        np.concatenate(grams) if grams else np.zeros(0, np.int32),
        np.concatenate(words) if words else np.zeros(0, np.int32),
        window,
        np.repeat(np.arange(len(texts)), windows),
    )


def _probability(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


@dataclass
class Model:
    """``weights``: each table row's vector times the difference of the two softmax columns."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def windows(self, bag: Bags) -> np.ndarray:
        return bag.means(self.weights) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        bag = bags(texts)
        starts = np.flatnonzero(np.diff(bag.window_text, prepend=-1))
        return _probability(self.scale * np.maximum.reduceat(self.windows(bag), starts) + self.shift)


class _Batch:
    """Some labelled texts, with what each n-gram adds to the average of its window."""

    def __init__(self, sample: list[tuple[str, int]]):
        bag = bags([text for text, _ in sample])
        each = np.bincount(bag.word, minlength=len(bag.word_window))
        sizes = np.maximum(np.bincount(bag.word_window, minlength=len(bag.window_text)), 1)
        self.gram = bag.gram
        self.window = bag.word_window.astype(np.int32)[bag.word]
        self.share = (1 / each / sizes[bag.word_window]).astype(np.float32)[bag.word]
        self.label = np.array([label for _, label in sample], float)
        self.text = bag.window_text
        self.wanted = self.label[self.text]
        self.learned = np.ones(len(self.text), bool)

    def values(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.window, weights[self.gram] * self.share, len(self.text))

    def worst(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, np.flatnonzero(np.diff(self.text, prepend=-1)))

    def narrow(self, values: np.ndarray) -> None:
        """Of a toxic text learn only the windows that score about as high as its worst one."""
        top = self.worst(values)[self.text]
        self.learned = (self.wanted == 0) | (values >= np.maximum(top - 1, 0)) | (values == top)


def _fit(batches: list[_Batch], vectors: np.ndarray, column: np.ndarray) -> float:
    """Descent with momentum on the vectors and the softmax column (both changed in place); returns the bias."""
    bias, pace, column_pace, bias_pace = 0.0, np.zeros_like(vectors), np.zeros_like(column), 0.0
    toxic = sum(float((batch.wanted * batch.learned).sum()) for batch in batches)
    clean = sum(float(((1 - batch.wanted) * batch.learned).sum()) for batch in batches)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in batches:
            weight = np.where(batch.wanted == 1, 0.5 / max(1, toxic), 0.5 / max(1, clean)) * batch.learned * len(batches)
            error = (_probability(batch.values(vectors @ column) + bias) - batch.wanted) * weight
            each = np.bincount(batch.gram, error[batch.window] * batch.share, len(vectors))
            pace *= 0.8
            pace -= np.outer(each, rate * column)
            column_pace = 0.8 * column_pace - rate * 1e-3 * (vectors.T @ each)
            bias_pace = 0.8 * bias_pace - 0.1 * error.sum()
            vectors += pace
            column += column_pace
            bias += float(bias_pace)
    return bias


def train(sample: list[tuple[str, int]]) -> Model | None:
    """Fit on labelled texts; ``None`` unless both labels occur.

    A toxic text has few toxic windows. The first round takes all its windows as
    toxic, each later one only those that the round before scored highest.
    """
    if len({label for _, label in sample}) < 2:
        return None
    draw = np.random.default_rng(7)
    mixed = [sample[place] for place in draw.permutation(len(sample))]
    batches = [_Batch(part) for number in range(BATCHES) if (part := mixed[number::BATCHES])]
    # Only rows that occur in the sample learn; those of n-grams never seen stay neutral.
    used = np.unique(np.concatenate([batch.gram for batch in batches]))
    for batch in batches:
        batch.gram = np.searchsorted(used, batch.gram).astype(np.int32)
    vectors = draw.uniform(-0.5, 0.5, (len(used), DIMENSIONS)) / (10 * DIMENSIONS)
    column = draw.normal(0, 1, DIMENSIONS)
    column *= COLUMN_NORM / np.linalg.norm(column)
    for _ in range(ROUNDS):
        bias = _fit(batches, vectors, column)
        values = [batch.values(vectors @ column) + bias for batch in batches]
        for batch, own in zip(batches, values):
            batch.narrow(own)
    # Platt scaling of the worst window, both classes with the same weight.
    labels = np.concatenate([batch.label for batch in batches])
    best = np.concatenate([batch.worst(own) for batch, own in zip(batches, values)])
    centre, spread = best.mean(), best.std() + 1e-9
    value, scale, shift = (best - centre) / spread, 1.0, 0.0
    each = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    for _ in range(500):
        error = (_probability(scale * value + shift) - labels) * each
        scale, shift = max(0.05, scale - 2 * float(error @ value)), shift - 2 * float(error.sum())
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    weights[used] = vectors @ column
    return Model(weights, bias, scale / spread, shift - scale * centre / spread)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = PER_CLASS,
    max_chars: int = MAX_CHARS,
    threshold: float = 0.5,
) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every row, from its whole text.

    Learns from at most ``per_class`` labelled texts of each class and of at
    most ``max_chars`` characters, never from rows whose crc32(id) mod 5 is 0.
    A null text counts as empty; a text without words has one empty window, so
    all such texts get the same score. Without labels of both classes every
    score is 0. Rows are kept one for one, an empty table gives none, ids may
    repeat or be null, other columns are not read.
    """
    model = train(labelled_sample(documents, labels, label, 5, 0, per_class, max_chars, id_column, text))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch, "text", SLICE):
                values = np.zeros(len(texts)) if shared.value is None else shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(1).slice(start, end - start),
                        pa.array(values, pa.float64()),
                        pa.array((values >= threshold).astype(np.int32)),
                    ],
                    [id_column, "held_out", "score", "predicted"],
                )

    key = F.col(id_column)
    columns = documents.select(key, (remainder(key, 5) == 0).alias("held_out"), F.col(text).alias("text"))
    key_type = columns.schema[0].dataType.simpleString()
    return columns.mapInArrow(score, f"`{id_column}` {key_type}, held_out boolean, score double, predicted int")


def without_toxic(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = PER_CLASS,
    max_chars: int = MAX_CHARS,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``documents``, all columns, that score below ``threshold``; learns as ``score_toxicity`` does.

    Without labelled texts of both classes every row stays; an empty table stays
    empty. Null texts count as empty, ids may repeat or be null.
    """
    model = train(labelled_sample(documents, labels, label, 5, 0, per_class, max_chars, id_column, text))
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch, text, SLICE):
                clean = shared.value.scores(texts) < threshold
                yield batch.slice(start, end - start).filter(pa.array(clean))

    return documents.mapInArrow(keep, documents.schema)
