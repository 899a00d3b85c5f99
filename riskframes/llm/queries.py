"""Registered queries of the corpus operators, thin over the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, minhash, mixing, ordinal, quality_rules, spotsigs, suffix_dedup, token_files, url_filter
from ._common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.bpe_round_trip(docs, path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = url_filter.word_counts(table(spark, sf_dir, "documents"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), corpus=corpus)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_file_report(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.grade(docs, ordinal.fit_on(docs, table(spark, sf_dir, "labels")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_rules": op2_quality_rules,
        "op3_mixing": op3_mixing,
        "op4_url_filter": op4_url_filter,
        "op5_spotsigs": op5_spotsigs,
        "op6_token_files": op6_token_files,
        "op7_minhash": op7_minhash,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_ordinal": op9_ordinal,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL}
