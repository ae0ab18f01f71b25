"""Quality scores by compression.

Two zstandard dictionaries are trained alike, one on good and one on bad
labelled text. A text that resembles good text packs smaller with the good one.
A logistic regression, fitted on labelled texts that no dictionary was built
from, turns that into a probability. It reads the difference of both sizes
normalised by the length, its share of their sum, both normalised sizes, the
log of the length, and squares and products of these: the length and the plain
compressibility of a text count by themselves too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices
from ledgerloom.llm.labelled import labelled_sample, remainder

PER_CLASS = 3000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 112_640
# A dictionary learns from texts of a class until they have so many bytes.
DICTIONARY_TEXT_BYTES = 4_000_000
# Bytes to learn from for each byte of a dictionary, and bytes of a piece it learns from.
BYTES_PER_BYTE = 8
PIECE_BYTES = 4096
LEAST_BYTES = 256
LEVEL = 3


def _pieces(texts: list[bytes], text_bytes: int) -> list[bytes]:
    """Pieces of the first texts that have ``text_bytes`` bytes together."""
    pieces, size = [], 0
    for text in texts:
        if size >= text_bytes:
            break
        pieces += [text[start : start + PIECE_BYTES] for start in range(0, len(text), PIECE_BYTES)]
        size += len(text)
    return pieces


def dictionaries(texts: list[list[bytes]], text_bytes: int = DICTIONARY_TEXT_BYTES) -> list[bytes] | None:
    """A trained dictionary for each class, of the same size and by the same way at every size.

    The class with fewer bytes decides the size of both, or the larger
    dictionary would pack anything better. None if a class is too small to train
    one at all, which takes about 8 kB.
    """
    classes = [_pieces(own, text_bytes) for own in texts]
    least = min(sum(map(len, pieces)) for pieces in classes)
    size = min(DICTIONARY_BYTES, max(LEAST_BYTES, least // BYTES_PER_BYTE))
    try:
        return [zstandard.train_dictionary(size, pieces).as_bytes() for pieces in classes]
    except zstandard.ZstdError:
        return None


class Sizes:
    """Compressed sizes of texts with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(data) if data else None,
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            for data in (good, bad)
        ]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The normalised difference, and what its meaning depends on: both sizes and the length."""
        sizes = np.array([[len(packer.compress(text)) for packer in self.packers] for text in texts], float)
        sizes = sizes.reshape(-1, 2)
        length = np.array([len(text) + 32 for text in texts], float)
        good, bad = sizes[:, 0] / length, sizes[:, 1] / length
        gap, share, log = good - bad, (good - bad) / (good + bad), np.log(length)
        base = np.column_stack([gap, share, good, bad, log])
        mixed = np.column_stack([np.abs(gap), gap * good, share * bad, share * log, good * log])
        return np.column_stack([base, base**2, mixed])


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        value = np.clip((features - self.centre) / self.spread, -12, 12) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def train(sample: list[tuple[str, int]], prior: float, dictionary_text_bytes: int = DICTIONARY_TEXT_BYTES) -> Model | None:
    """Dictionaries from one half of each class, calibration on the other; ``prior`` is the share of label 1."""
    texts = [[text.encode() for text, label in sample if label == value] for value in (0, 1)]
    if min(map(len, texts)) < 2:
        return None
    trained = dictionaries([own[::2] for own in texts], dictionary_text_bytes)
    if trained is None:
        return None
    bad, good = (own[1::2] for own in texts)
    sizes = Sizes(trained[1], trained[0])
    features = np.vstack([sizes.features(bad), sizes.features(good)])
    wanted = np.repeat([0.0, 1.0], [len(bad), len(good)])
    # The sample holds the classes alike, the corpus does not.
    each = np.where(wanted == 1, prior / len(good), (1 - prior) / len(bad))
    centre, spread = features.mean(0), features.std(0) + 1e-9
    design = np.column_stack([np.clip((features - centre) / spread, -12, 12), np.ones(len(features))])
    ridge = np.eye(design.shape[1]) * 1e-5
    weights = np.zeros(design.shape[1])
    for _ in range(40):
        guess = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ ((wanted - guess) * each) - ridge @ weights
        curve = design.T @ (design * (guess * (1 - guess) * each)[:, None]) + ridge
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return Model(trained[1], trained[0], centre, spread, weights)


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = PER_CLASS,
    max_chars: int = MAX_CHARS,
    threshold: float = 0.7,
    dictionary_text_bytes: int = DICTIONARY_TEXT_BYTES,
) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every row, from its whole text.

    Learns from at most ``per_class`` labelled texts of each class and of at
    most ``max_chars`` characters, never from rows whose crc32(id) mod 4 is 2.
    Every other text of a class goes to its dictionary, which reads them until
    they have ``dictionary_text_bytes`` bytes; both dictionaries have an eighth
    of the bytes that the smaller class gives, and at most 112,640.
    A null text counts as empty; all empty texts get the same score. With fewer
    than two labelled texts of either class, or about 8 kB of either, every
    score is the share of label 1 (1 without labels). Rows are kept one for one,
    an empty table gives none, ids may repeat or be null, other columns are not
    read.
    """
    known = labels.where((remainder(F.col(id_column), 4) != 2) & F.col(label).isin(0, 1))
    prior = known.agg(F.avg(label).alias("share")).first()["share"]
    prior = 1.0 if prior is None else float(prior)
    sample = labelled_sample(documents, labels, label, 4, 2, per_class, max_chars, id_column, text)
    model = train(sample, prior, dictionary_text_bytes)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sizes = fitted and Sizes(fitted.good, fitted.bad)
        for batch in batches:
            for start, end, texts in text_slices(batch, "text"):
                values = np.full(len(texts), prior)
                if fitted is not None:
                    values = fitted.probability(sizes.features([value.encode() for value in texts]))
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
    columns = documents.select(key, (remainder(key, 4) == 2).alias("held_out"), F.col(text).alias("text"))
    key_type = columns.schema[0].dataType.simpleString()
    return columns.mapInArrow(score, f"`{id_column}` {key_type}, held_out boolean, score double, predicted int")
