"""Language identification by mixtures of languages.

A text is a bag of letter trigrams, each written by one of the languages it
mixes. Expectation-maximisation estimates the languages' shares from the
trigrams' likelihoods. A language is added to the set that explains a text only
if the likelihood grows by more than a penalty per language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices
from ledgerloom.llm.labelled import remainder

UNKNOWN = "und"
PER_LANGUAGE = 1000
TABLE_BITS = 16
SMOOTHING = 0.2
ROUNDS = 12
# In units of log(trigrams): a letter is part of three trigrams, so they count three times.
PENALTY = 3.0
_CHUNK = 1 << 21
_DRAWS = 1 << 30


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Each character as one number more if it is a letter or a mark on one, else 0; whether it is a letter."""
    kinds = [unicodedata.category(chr(code))[0] for code in range(0x110000)]
    letter = np.array([kind == "L" for kind in kinds])
    known = letter | np.array([kind == "M" for kind in kinds])
    return np.where(known, np.arange(1, 0x110001), 0).astype(np.uint32), letter


@dataclass
class Bags:
    """Distinct trigrams of texts, by text: the text's number, the trigram's place in the table, how often."""

    text: np.ndarray
    place: np.ndarray
    count: np.ndarray
    lettered: np.ndarray


def bags(texts: list[str]) -> Bags:
    """Trigrams around every letter; where a word begins or ends, a blank takes the neighbour's place."""
    lowered = [text.lower() for text in texts]
    ends = np.cumsum([len(text) + 1 for text in lowered])
    whole = "\n".join(lowered)
    number, letter = _letters()
    lettered = np.zeros(len(texts), bool)
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(whole), _CHUNK):
        before = min(start, 1)
        piece = whole[start - before : start + _CHUNK + 1]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[0], number[points], [0]]).astype(np.uint32)
        at = np.arange(before, min(before + _CHUNK, len(points)))
        at = at[codes[at + 1] > 0]
        mixed = codes[at] * np.uint32(0x9E3779B1) + codes[at + 1] * np.uint32(0x85EBCA77) + codes[at + 2] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        text = np.searchsorted(ends, at + (start - before), "right")
        lettered[text[letter[points[at]]]] = True
        keys = text << TABLE_BITS | (mixed >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
        own, often = np.unique(keys, return_counts=True)
        # A text that spans pieces has a trigram in several of them.
        found, places = np.unique(np.concatenate([found, own]), return_inverse=True)
        counts = np.bincount(places, np.concatenate([counts, often]), len(found)).astype(np.int64)
    return Bags(found >> TABLE_BITS, found & ((1 << TABLE_BITS) - 1), counts, lettered)


@dataclass
class Mixture:
    """``languages`` of each text: shares that add up to one, and the score of the first."""

    shares: np.ndarray
    score: np.ndarray


@dataclass
class Model:
    """``ratios``: how much likelier each language writes a trigram than the languages' mean."""

    languages: list[str]
    ratios: np.ndarray

    def _climb(self, shares: np.ndarray, text: np.ndarray, starts: np.ndarray, count: np.ndarray, ratio: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after some rounds of expectation-maximisation, and their log likelihood."""
        total = np.add.reduceat(count, starts)[:, None]
        for _ in range(rounds):
            part = shares[text] * ratio
            part *= (count / part.sum(1))[:, None]
            shares = np.add.reduceat(part, starts) / total
        likely = np.add.reduceat(count * np.log((shares[text] * ratio).sum(1)), starts)
        return shares, likely

    def mixtures(self, bag: Bags) -> Mixture:
        """Shares of every language in every text; zero throughout for texts without letters."""
        size = len(self.languages)
        result = Mixture(np.zeros((len(bag.lettered), size)), np.zeros(len(bag.lettered)))
        if not len(bag.text) or not size:
            return result
        starts = np.flatnonzero(np.diff(bag.text, prepend=-1))
        which = bag.text[starts]
        text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bag.text))))
        count, ratio = bag.count.astype(np.float64), self.ratios[bag.place].astype(np.float64)
        alone = np.add.reduceat(count[:, None] * np.log(ratio), starts)
        full, most = self._climb(np.full((len(starts), size), 1 / size), text, starts, count, ratio, ROUNDS)
        penalty = PENALTY * np.log(np.add.reduceat(count, starts) + 1)
        best, chosen = alone.max(1), np.eye(size)[alone.argmax(1)]
        # Letters are in three trigrams each, which would make a single language look too certain.
        odds = np.exp((alone - best[:, None]) / 3)
        score = 1 / odds.sum(1)
        # All languages together explain a text best; where even they gain too little, one does.
        open_ = np.flatnonzero(most - best > penalty)
        order = np.argsort(-full, axis=1, kind="stable")
        for members in range(2, size + 1):
            if not len(open_):
                break
            mask = np.zeros((len(open_), size))
            np.put_along_axis(mask, order[open_, :members], 1.0, 1)
            begin = np.maximum(full[open_], 1e-9) * mask
            inside = np.zeros(len(starts), bool)
            inside[open_] = True
            rows = np.flatnonzero(inside[text])
            own = np.searchsorted(open_, text[rows])
            first = np.flatnonzero(np.diff(own, prepend=-1))
            shares, likely = self._climb(begin / begin.sum(1, keepdims=True), own, first, count[rows], ratio[rows], ROUNDS)
            likely -= (members - 1) * penalty[open_]
            better = likely > best[open_]
            chosen[open_[better]], best[open_[better]] = shares[better], likely[better]
            score[open_[better]] = shares[better].max(1)
            # Two languages may not suffice where three do, so only a text that all sets fail is left early.
            open_ = open_[most[open_] - members * penalty[open_] > best[open_]]
        known = bag.lettered[which]
        result.shares[which[known]], result.score[which[known]] = chosen[known], np.clip(score[known], 0, 1)
        return result


def learn(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Trigram likelihoods of every language from at most ``per_language`` whole texts of each.

    Never learns from rows whose crc32(id) mod 4 is 2, or whose language or
    text is null. Texts are taken in the order of a hash of their id. The driver
    gets 65,536 counts a language.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where((remainder(F.col("id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 34)
    # About twice the texts needed, drawn before any text moves; one row per language is broadcast.
    drawn = known.groupBy("lang").agg((F.lit(2.0 * per_language * _DRAWS) / F.count(F.lit(1))).alias("below"))
    near = known.join(F.broadcast(drawn), "lang").where(draw < F.col("below"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(5)), "id", F.xxhash64("text"))
    sample = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for start, end, texts in text_slices(batch, "text"):
                bag = bags(texts)
                own = np.array(names[start:end], object)[bag.text] if len(bag.text) else np.zeros(0, object)
                for name in set(names[start:end]):
                    mine = own == name
                    added = np.bincount(bag.place[mine], bag.count[mine], 1 << TABLE_BITS).astype(np.int64)
                    totals[name] = totals.get(name, 0) + added
        for name, total in totals.items():
            places = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places), pa.string()), pa.array(places.astype(np.int32)), pa.array(total[places])],
                ["lang", "place", "n"],
            )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, place int, n long")
    table = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(table.column("lang").unique().to_pylist())
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    column = np.searchsorted(np.array(languages, object), np.array(table.column("lang").to_pylist(), object)) if languages else []
    counts[table.column("place").to_numpy(), column] = table.column("n").to_numpy()
    likely = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * (1 << TABLE_BITS))
    return Model(languages, (likely / likely.mean(1, keepdims=True)).astype(np.float32) if languages else likely)


def identify(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """``held_out``, ``lang_pred``, ``score``, ``languages`` and ``shares`` of every row, from its whole text.

    ``languages`` lists the languages that the text is taken to mix, the largest
    share first (ties by name), and ``shares`` what each of them wrote;
    ``lang_pred`` is the first. ``score`` is its share, or, if it is alone, how
    likely it is against each other single language. A text that is null or has
    no letter is ``und`` with score 0 and no languages, and so is every text if
    there is nothing to learn from. Rows are kept one for one, an empty table
    gives none, ids may repeat or be null; equal texts get equal results; other
    columns are not read.
    """
    model = learn(documents, id_column, text, lang, per_language)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array([*fitted.languages, ""], object)
        for batch in batches:
            for start, end, texts in text_slices(batch, "text"):
                found = fitted.mixtures(bags(texts))
                order = np.argsort(-found.shares, axis=1, kind="stable")
                members = [row[: np.count_nonzero(own > 0)] for row, own in zip(order, found.shares)]
                mixed = [names[own].tolist() for own in members]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(1).slice(start, end - start),
                        pa.array([own[0] if own else UNKNOWN for own in mixed], pa.string()),
                        pa.array(found.score),
                        pa.array(mixed, pa.list_(pa.string())),
                        pa.array([own[row] for own, row in zip(found.shares, members)], pa.list_(pa.float64())),
                    ],
                    [id_column, "held_out", "lang_pred", "score", "languages", "shares"],
                )

    key = F.col(id_column)
    columns = documents.select(key, (remainder(key, 4) == 2).alias("held_out"), F.col(text).alias("text"))
    key_type = columns.schema[0].dataType.simpleString()
    shape = "held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    return columns.mapInArrow(predict, f"`{id_column}` {key_type}, {shape}")
