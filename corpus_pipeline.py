"""From raw documents to token counts: rules, near duplicates, personal data, mix, tokens.

A null text, source, lang or doc_id passes every stage that does not judge it; empty tables give empty results; repeated
rows go with the near duplicates, and a doc_id is repeated afterwards as often as the mix takes a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, mixing, ngram_join, quality_rules, surrogates
from millrace.llm._common import only_ids, small_batches, written
from millrace.llm.queries import KEY, TEST_KEY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RANKS = "byte_bpe_50k.tiktoken"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, without the lines that many documents of their source share."""
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles at a similarity of 0.8 or more. Of rows with
    one doc_id and text one stays; a row without a doc_id links with nothing and stays."""
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        once = only_ids(docs, twice).dropDuplicates(["doc_id", "text"])
        docs = only_ids(docs, twice, how="left_anti").unionByName(once)
    found = ngram_join.link(docs, ngram_join.Rule(width=5, percent=80))
    gone = written(found.where("doc_id <> component_id").select("doc_id"), "gone")
    return only_ids(docs, gone, how="left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data and secrets, with the key of the session (see millrace.llm.queries.KEY)."""
    return surrogates.replace(docs, spark.conf.get(KEY, TEST_KEY)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: sources weigh 3, 1, 2, repeating, and share 150 % of all words."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of ids and of the bytes decoded from them."""
    import public_tokenizers

    with small_batches(spark):
        return written(byte_bpe.digests(docs, public_tokenizers.path(RANKS)), "tokens")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Components, keyed surrogates and the merge replay are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
