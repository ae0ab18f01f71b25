"""The registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.conversations import damaged, repair
from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.languages import identify
from ledgerloom.llm.neighbours import search
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import score_quality
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.suffix_dedup import remove_repeats
from ledgerloom.llm.token_counts import count_tokens
from ledgerloom.llm.token_files import token_digest
from ledgerloom.llm.toxicity import score_toxicity
from ledgerloom.llm.url_filter import judge_urls
from ledgerloom.llm.whitening import whiten

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), limit=4096)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), longest=2048, end_id=1)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle_words=3, max_bits=3)


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, count=10)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(table(spark, folder, "documents"), end_id=2)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.5)


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations"))
    return repair(rows, "conv", copies="copies").withColumnRenamed("conv", "conv_id")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), components=32)


def op13_languages(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


CORPUS_QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_neighbours": op6_neighbours,
    "op7_url_filter": op7_url_filter,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_languages": op13_languages,
}

CORPUS_SQL = {
    "op2_decontamination": """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place, len(w) AS n_words
  FROM (SELECT doc_id, regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
), items AS (
  SELECT item_id, w, least(len(w), 10) AS n
  FROM (SELECT item_id, regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, w[start : start + n - 1] AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS start FROM items)
), sizes AS (
  SELECT DISTINCT n FROM grams
), windows AS (
  SELECT doc_id, place, n, list(word) OVER (PARTITION BY doc_id, n ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead
  FROM words, sizes
), hits AS (
  SELECT doc_id, place, windows.n, item_id
  FROM windows JOIN grams ON windows.n = grams.n AND windows.ahead[1 : windows.n] = grams.gram
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(place, place + n)) AS word FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op7_url_filter": """
WITH found AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)([^?#]*)', ['host', 'path']) AS part FROM pages
), parsed AS (
  SELECT page_id, coalesce(translate(part.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(part.path, '') AS path
  FROM found
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path))
          FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parsed
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""",
}
