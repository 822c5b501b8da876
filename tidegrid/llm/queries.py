"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, media, mixing, packing, quality_neighbours, quality_rules, simhash, suffix_dedup, toxicity, url_filter
from .common import held_out, table

#: (host, path, verdict) of the rules that op3 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: Epochs that the most repeated source may have where sources are mixed.
MAX_REPETITION = 1.5


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: each embedding is drawn as a picture, and copies are sought among all pictures."""
    images = media.pictures(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.copies(images).select(F.col("id").alias("vec_id"), "class_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT k.host, k.path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) k
  JOIN rules ON (k.host = r_host OR suffix(k.host, '.' || r_host)) AND prefix(k.path, r_path)
  GROUP BY k.host, k.path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = toxicity.learn(docs, labels, ["junk", "toxic"])
    return toxicity.score(docs.select("doc_id", "text"), chain).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    found = quality_rules.judge(docs.select("doc_id", "text"), model)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"))
    return quality_neighbours.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_tokens"))
    return mixing.mix(docs, max_repetition=MAX_REPETITION, tokens=F.col("n_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_copies": op1_media_copies,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_neighbours": op7_quality_neighbours,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_url_filter": OP3_SQL}
