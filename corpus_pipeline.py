"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing of sources, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Null
texts, null ids, repeated rows and empty tables are treated as the operators' docstrings say. A stage that drops documents
joins the few dropped keys: sent to all executors where their counted number allows it, else by a shuffle. Stages that work in Python
workers first let executors give back the heap of the stages before, as an executor's limit counts both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframes.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from riskframes.llm._common import discard, relieve, table, written
from riskframes.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limits; ``n_chars`` is of the text that is left."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a likeness of 0.8 or more."""
    relieve(spark)
    return minhash.without_duplicates(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that one with a smaller id holds; ``n_chars`` is of the text that is left."""
    relieve(spark)
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, and a digest of what they decode to."""
    relieve(spark)
    path = tokenizer_path("word_bpe_49k.json")
    rows = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Suffix arrays and byte-pair merges can't be put in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
