"""Token counts of whole texts, huge ones in overlapping chunks.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a position where both have a token boundary and where the
vocabulary proves that none can be missing: no piece holds the characters on its
two sides next to each other, so no merge ever reaches across it and the tokens
on either side do not depend on the other. Where the overlap has no such
position, it is widened, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
SPACE = "▁"


class PieceCounter:
    """Counts the pieces that the model gives for a text."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        self.neighbours = set()
        for number in range(self.model.vocab_size()):
            if self.model.is_byte(number) or self.model.is_control(number) or self.model.is_unknown(number):
                continue
            piece = self.model.id_to_piece(number)
            self.neighbours.update(zip(piece, piece[1:]))

    def counts(self, texts: list[str]) -> list[int]:
        short = [text for text in texts if len(text) <= self.chunk]
        sizes = iter([len(ids) for ids in self.model.encode(short, num_threads=1)] if short else [])
        return [next(sizes) if len(text) <= self.chunk else self.spliced(text) for text in texts]

    def stable(self, text: str, place: int) -> bool:
        before, after = (SPACE if char == " " else char for char in text[place - 1 : place + 1])
        return (before, after) not in self.neighbours

    def starts(self, text: str, start: int, end: int) -> np.ndarray:
        """Where each token of a chunk starts, in characters of the whole text."""
        offsets = self.model.encode(text[start:end], return_type="offset_mapping")["offsets"]
        return np.array(offsets, np.int64).reshape(-1, 2)[:, 0] + start

    def spliced(self, text: str) -> int:
        count, base, start = 0, 0, 0
        end = min(len(text), self.chunk)
        tokens = self.starts(text, start, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                following = end - overlap
                if following <= base + 1:
                    # The overlap has grown over the whole chunk: the chunk grows instead.
                    end = min(len(text), end + max(self.chunk, end - start))
                    tokens = self.starts(text, start, end)
                    break
                stop = min(len(text), following + self.chunk + overlap)
                more = self.starts(text, following, stop)
                # The first token of a chunk has a mark before it, so splices lie behind it.
                shared = np.intersect1d(tokens[tokens > following], more[more < end])
                place = next((int(x) for x in shared[len(shared) // 2 :] if self.stable(text, x)), None)
                if place is None:
                    place = next((int(x) for x in shared if self.stable(text, x)), None)
                if place is not None:
                    count += int(np.count_nonzero((tokens >= base) & (tokens < place)))
                    base, start, end, tokens = place, following, stop, more
                    break
                self.widened += 1
                overlap *= 4
        return count + int(np.count_nonzero(tokens >= base))


def count_tokens(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    model: str | None = None,
    limit: int = 4096,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    A null text counts as empty: no bytes, no tokens. Rows are kept one for one,
    ids may repeat or be null, other columns are not read, an empty table gives
    an empty one. A text is encoded by the task that holds it; memory follows
    the longest text, and the encoder only ever sees a chunk.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path, chunk, overlap)
        for batch in batches:
            for start, end, texts in text_slices(batch, "text"):
                sizes = [len(value.encode()) for value in texts]
                tokens = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([size > limit for size in tokens], pa.bool_()),
                    ],
                    [id_column, "n_bytes", "n_tokens", "over_limit"],
                )

    columns = documents.select(F.col(id_column), F.col(text).alias("text"))
    key_type = columns.schema[0].dataType.simpleString()
    return columns.mapInArrow(count, f"`{id_column}` {key_type}, n_bytes long, n_tokens long, over_limit boolean")
