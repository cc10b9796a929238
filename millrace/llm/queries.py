"""The operators' queries, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_join, language_id, license_scan, mixing, ngram_join, oracles, quality_fm, quality_rules, substring_dedup, surrogates

RANKS = "byte_bpe_50k.tiktoken"
#: Session setting with the key of surrogates; the value here is for tests alone, being public.
KEY, TEST_KEY = "spark.millrace.surrogate.key", "a public key, for tests alone"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, state = mixing.plan(table(spark, sf_dir, "documents"))
    rows = mixing.rated(slim, state)
    return rows.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels.where(~language_id.held_out()))
    return quality_fm.score(docs, machine).select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace(table(spark, sf_dir, "documents"), spark.conf.get(KEY, TEST_KEY))
    return found.select("doc_id", "text", F.col("_entities").alias("n_entities"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language_id, op3_license_scan, op4_ngram_join, op5_quality_fm, op6_embedding_join, op7_byte_bpe, op8_quality_rules, op9_substring_dedup, op10_surrogates)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": oracles.licenses(),
        "op4_ngram_join": oracles.ngram_join(),
        "op6_embedding_join": oracles.embedding_join(),
        "op8_quality_rules": oracles.rules(),
        "op9_substring_dedup": oracles.substring_dedup(),
    }
