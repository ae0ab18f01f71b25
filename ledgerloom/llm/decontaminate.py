"""Benchmark decontamination with DataFrame operations only.

The benchmark's windows of ten normalised words become a broadcast hash set.
Every document is cut into words once, every window hashed once; the windows
are exploded straight into the probe, and a hit is verified word by word there,
so neither words nor windows of a document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, parts_for

WINDOW_WORDS = 10
# Words and item ids that one broadcast may hold, some 40 bytes each.
BROADCAST_ENTRIES = 5_000_000

# A word with what follows it up to the next word, and what stands before the first.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = "".join(chr(code) for code in range(128) if not chr(code).isalnum())


def words_of(text: Column) -> Column:
    """Lower-cased A-Z; words are runs of a-z, 0-9 and non-ASCII characters. Null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(spaced, " "), "")


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _window_hashes(hashes: str, window: int) -> Column:
    """The hash of each run of ``window`` word hashes, none for shorter arrays.

    The column is named several times here, so the optimiser does not copy its
    expression into the lambda, where it would run once per window.
    """
    size = F.size(hashes)
    starts = F.when(size >= window, F.sequence(F.lit(0), size - window)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda start: _combined([F.get(hashes, start + shift) for shift in range(window)]))


def _combined(word_hashes: list[Column]) -> Column:
    return F.xxhash64(*word_hashes)


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Each distinct window: ``gram`` (its words), ``n``, ``hash`` and the ``items`` it occurs in.

    An item of fewer words than a window is one window, an item without words none.
    """
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    sized = items.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    grams = sized.select("item", "n", "words", F.explode(starts).alias("start")).select(
        "item", "n", F.slice("words", F.col("start"), F.col("n")).alias("gram")
    )
    return (
        grams.groupBy("gram", "n")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("word_hashes", _word_hashes(F.col("gram")))
        .withColumn("hash", _combined([F.get("word_hashes", F.lit(shift)) for shift in range(window)]))
        .drop("word_hashes")
    )


def _probe(rows: DataFrame, grams: DataFrame, sizes: list[int], first_part: bool) -> DataFrame:
    """Verified hits of one part of the windows; with the first part also one row per document.

    ``hashes`` is a document's windows by size, in the order of ``sizes``, after
    a leading 0 that stands for the document itself.
    """
    itself = grams.sparkSession.range(1).select(
        F.lit(None).cast("array<string>").alias("gram"),
        F.lit(0).alias("n"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("hash"),
    )
    sought = grams.select("gram", "n", "items", "hash")
    sought = F.broadcast(sought.unionByName(itself) if first_part else sought)
    # The outer form keeps the optimiser from testing for empty arrays first, by
    # computing the hashes there as well; none is empty.
    probes = rows.select("row", "id", "words", F.posexplode_outer("hashes").alias("place", "hash"))
    # Where the windows of a size begin in ``hashes``.
    count = F.size("words")
    before, begin = F.lit(1), F.lit(0)
    for size in sizes:
        begin = F.when(F.col("n") == size, before).otherwise(begin)
        before = before + F.greatest(count - (size - 1), F.lit(0))
    start = F.col("place") - begin + 1
    same = (
        (F.col("n") > 0)
        & (start >= 1)
        & (start + F.col("n") - 1 <= count)
        & (F.slice("words", F.greatest(start, F.lit(1)), F.col("n")) == F.col("gram"))
    )
    verified = F.when(F.col("n") == 0, F.col("place") == 0).otherwise(same)
    return (
        probes.join(sought, "hash")
        .where(verified)
        .select("row", "id", F.size("words").alias("n_words"), "n", start.alias("start"), "items")
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    broadcast_entries: int = BROADCAST_ENTRIES,
    with_hits: bool = False,
) -> DataFrame:
    """Per row ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    ``with_hits`` adds ``hits``: ``start`` (from 1) and ``n`` of the words of
    each occurrence, and ``items``, the ids. A word is hit if it lies in an
    occurrence of a benchmark window. ``items`` are the ids of items with such
    windows, as text; items with a null id mark words but are not named. A null
    or empty text has no words. Rows are kept one for one, ids may repeat or be
    null, other columns are not read. An empty table gives no rows, an empty
    benchmark no hits. A benchmark too large for one broadcast is probed part by
    part.
    """
    grams = checkpointed(benchmark_windows(benchmark, item_column, item_text, window), "benchmark-windows")
    entries = grams.agg(F.coalesce(F.sum(F.col("n") + F.size("items")), F.lit(0)).alias("n")).first()["n"]
    parts = parts_for(entries, broadcast_entries)
    # At most ``window`` numbers.
    sizes = sorted(row["n"] for row in grams.select("n").distinct().collect())
    rows = (
        documents.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), words_of(F.col(text)).alias("words")
        )
        .withColumn("word_hashes", _word_hashes(F.col("words")))
        .withColumn(
            "hashes",
            F.concat(
                F.array(F.lit(0).cast("long")),
                *[_window_hashes("word_hashes", size) for size in sizes],
            ),
        )
    )
    found = None
    for part in range(parts):
        own = grams if parts == 1 else grams.where(F.pmod(F.col("hash"), F.lit(parts)) == part)
        hits = _probe(rows, own, sizes, part == 0)
        found = hits if found is None else found.unionByName(hits)
    hit = F.when(F.col("n") > 0, F.struct("start", "n"))
    merged = found.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.collect_set("items").alias("item_lists"),
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def cover(state: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        new = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + new).alias("total"))

    items = F.array_sort(F.array_distinct(F.flatten("item_lists")))
    counted = merged.withColumn("n_hit", F.aggregate("hits", none, cover)["total"]).withColumn("items", items)
    return counted.select(
        F.col("id").alias(id_column),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *(["hits", "items"] if with_hits else []),
    )


def _key(documents: DataFrame, id_column: str, text: str) -> Column:
    return F.struct(documents[id_column].alias("id"), F.xxhash64(documents[text]).alias("text"))


def without_windows(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """All rows and columns of ``documents``; words in an occurrence of a benchmark window are cut out.

    A word goes with what stands between it and the next one. Other texts,
    null ones too, stay as they are.
    """
    keyed = documents.select(_key(documents, id_column, text).alias("key"), text)
    judged = contamination(keyed, benchmark, "key", text, with_hits=True, **options)
    spans = F.aggregate("hits", F.array().cast("array<struct<start:int,stop:int>>"), _merged)
    bad = judged.where("contaminated").select(
        F.col("key.id").alias("bad_id"), F.col("key.text").alias("bad_text"), spans.alias("spans")
    )
    bad = checkpointed(bad.dropDuplicates(["bad_id", "bad_text"]), "contaminated-spans")
    same = documents[id_column].eqNullSafe(bad["bad_id"]) & (F.xxhash64(documents[text]) == bad["bad_text"])
    rows = documents.select(F.struct("*").alias("row"), F.col(id_column), F.col(text)).join(bad, same, "left")
    body = F.col("row").getField(text)
    pieces = F.regexp_extract_all(body, F.lit(f"{_WORD}+{_GAP}*"), F.lit(0))
    kept = F.filter(pieces, lambda piece, place: ~F.exists("spans", lambda span: _within(place + 1, span)))
    cut = F.concat(F.regexp_extract(body, f"^{_GAP}*", 0), F.array_join(kept, ""))
    new = F.when(F.col("spans").isNull(), body).otherwise(cut)
    names = documents.columns
    return rows.select(*[(new if name == text else F.col("row").getField(name)).alias(name) for name in names])


def _merged(spans: Column, hit: Column) -> Column:
    """Hits come in order of their starts: one that touches the last span lengthens it."""
    last = F.try_element_at(spans, F.lit(-1))
    stop = (hit["start"] + hit["n"]).cast("int")
    longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], stop).alias("stop"))
    new = F.struct(hit["start"].cast("int").alias("start"), stop.alias("stop"))
    before = F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0)))
    touches = (F.size(spans) > 0) & (last["stop"] >= hit["start"])
    return F.when(touches, F.concat(before, F.array(longer))).otherwise(F.concat(spans, F.array(new)))


def _within(place: Column, span: Column) -> Column:
    return (place >= span["start"]) & (place < span["stop"])


def without_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """The rows of ``documents``, all columns, that no benchmark window occurs in.

    Rows are matched by id and text hash: rows alike in both share the verdict.
    An empty table stays empty, an empty benchmark leaves every row.
    """
    key = _key(documents, id_column, text)
    judged = contamination(documents.select(key.alias("key"), text), benchmark, "key", text, **options)
    # The verdicts are written first, so that the join is planned for their true size.
    bad = checkpointed(judged.where("contaminated").select("key.id", "key.text").distinct(), "contaminated")
    same = documents[id_column].eqNullSafe(bad["id"]) & (F.xxhash64(documents[text]) == bad["text"])
    return documents.join(bad, same, "left_anti")
