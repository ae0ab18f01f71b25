"""Keywords found in texts through an index of their rarest character runs.

A keyword occurs in a text only where its runs of three characters do. Every
keyword is indexed under the one of its runs that the fewest texts hold, so a
text meets few keywords, and only those are searched for in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keywords import constant

RUN = 3
# Texts in which the runs of keywords are counted; they decide speed, not hits.
SAMPLE_TEXTS = 200
# Keywords shorter than a run that are searched for by name; more are indexed like the others.
SHORT_SEARCHES = 64
# Keywords that are broadcast at most, about a hundred megabytes.
KEYWORDS_BROADCAST = 1_000_000
# A run that indexes more keywords than this is dealt out in a shuffled join.
HOT_RUN = 10_000
# A table of bits tells which runs index any keyword.
TABLE_BITS = 18


def runs(text: Column, size: int = RUN) -> Column:
    """Distinct character runs of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _place(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(1 << TABLE_BITS)).cast("int")


def keyword_index(keywords: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``keyword`` and ``run``: its rarest run among a bounded sample of texts, ties by the run itself.

    A keyword shorter than three characters is its own run. The sample is a few
    texts as they come; another one gives another index and the same hits.
    """
    own = F.when(F.length("keyword") < RUN, F.array("keyword")).otherwise(runs(F.col("keyword")))
    every = keywords.select("keyword", F.explode(own).alias("run"))
    sample = texts.select(F.col(text).alias("text")).limit(SAMPLE_TEXTS)
    held = sample.select(F.explode(runs(F.col("text"))).alias("run")).groupBy("run").count()
    ranked = every.join(held, "run", "left").select("keyword", "run", F.coalesce("count", F.lit(0)).alias("texts"))
    return ranked.groupBy("keyword").agg(F.min(F.struct("texts", "run")).alias("best")).select("keyword", "best.run")


def _met(text: Column, places: list[int], short: list[str], sizes: list[int]) -> Column:
    """The runs of a text that index a keyword, and maybe a few that share a bit with one."""
    words = [0] * (1 << (TABLE_BITS - 6))
    for place in places:
        words[place >> 6] |= 1 << (place & 63)
    table = constant([word - (1 << 64) if word >> 63 else word for word in words], "array<bigint>")

    def known(run: Column) -> Column:
        place = _place(run)
        return F.getbit(F.get(table, F.shiftright(place, 6)), F.pmod(place, F.lit(64))) == 1

    found = [F.filter(runs(text), known)]
    if short and len(short) <= SHORT_SEARCHES:
        found.append(F.filter(constant(short, "array<string>"), lambda run: F.contains(text, run)))
    elif short:
        found += [F.filter(runs(text, size), known) for size in sizes]
    return found[0] if len(found) == 1 else F.concat(*found)


def keyword_hits(texts: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """The columns of ``texts`` and ``keyword``, one row for each keyword that occurs in a text.

    ``keywords`` holds a column ``keyword`` without empty texts. One pass over
    the texts, however many keywords there are: a text's runs are first looked
    up in a table of bits, so a row is made only for a run that indexes a
    keyword. The index is broadcast up to ``KEYWORDS_BROADCAST`` keywords and
    shuffled beyond, where runs that index very many keywords are dealt out.
    """
    return counted_hits(texts, text, keywords)[0]


def counted_hits(texts: DataFrame, text: str, keywords: DataFrame) -> tuple[DataFrame, int]:
    """``keyword_hits`` and the number of keywords. An empty keyword is an error, a null one is left out."""
    index = keyword_index(keywords.where(F.col("keyword").isNotNull()), texts, text).persist()
    short = F.when(F.length("run") < RUN, F.col("run"))
    # At most 2**TABLE_BITS places reach the driver, and one short run more than are searched for by name.
    found = index.agg(
        F.count(F.lit(1)).alias("keywords"),
        F.collect_set(_place(F.col("run"))).alias("places"),
        F.slice(F.sort_array(F.collect_set(short)), 1, SHORT_SEARCHES + 1).alias("short"),
        F.sort_array(F.collect_set(F.length(short))).alias("sizes"),
    ).first()
    if 0 in found["sizes"]:
        raise ValueError("empty keyword")
    met = texts.withColumn("_run", F.explode(_met(F.col(text), found["places"], found["short"], found["sizes"])))
    listed = index.select("keyword", F.col("run").alias("_run"))
    if found["keywords"] <= KEYWORDS_BROADCAST:
        candidates = met.join(F.broadcast(listed), "_run")
    else:
        hot = listed.groupBy("_run").count().where(F.col("count") > HOT_RUN)
        # At most keywords / HOT_RUN runs are hot.
        hot = F.broadcast(hot.select("_run", F.ceil(F.col("count") / HOT_RUN).cast("int").alias("_lots")))
        lots = F.coalesce("_lots", F.lit(1))
        lot = F.pmod(F.xxhash64("keyword"), lots).cast("int")
        dealt = listed.join(hot, "_run", "left").select("keyword", "_run", lot.alias("_lot"))
        copied = met.join(hot, "_run", "left").withColumn("_lot", F.explode(F.sequence(F.lit(0), lots - 1)))
        candidates = copied.join(dealt, ["_run", "_lot"]).drop("_lot", "_lots")
    return candidates.where(F.contains(F.col(text), F.col("keyword"))).drop("_run"), found["keywords"]


def shadowed_keywords(rules: DataFrame) -> DataFrame:
    """Keywords of a rule table that can never decide a label.

    Takes ``priority, label, keyword``. A text that holds a keyword holds every
    keyword inside it, so a longer keyword is idle where a shorter one inside it
    has a better (lower) priority. Returns ``keyword, label`` and, for the best
    keyword inside it (by priority, then label, then text), ``by_keyword,
    by_label``. A keyword under several labels counts with its best one. Empty
    keywords are left out.
    """
    best = (
        rules.where(F.length("keyword") > 0)
        .groupBy("keyword")
        .agg(F.min(F.struct("priority", "label")).alias("best"))
        .select("keyword", "best.priority", "best.label")
    )
    longer = best.select(F.col("keyword").alias("text"), F.col("priority").alias("own"), F.col("label").alias("own_label"))
    inside = keyword_hits(longer, "text", best).join(best, "keyword")
    beaten = inside.where((F.col("keyword") != F.col("text")) & (F.col("priority") < F.col("own")))
    first = F.min(F.struct("priority", "label", "keyword")).alias("by")
    found = beaten.groupBy("text", "own_label").agg(first)
    return found.select(
        F.col("text").alias("keyword"),
        F.col("own_label").alias("label"),
        F.col("by.keyword").alias("by_keyword"),
        F.col("by.label").alias("by_label"),
    )
