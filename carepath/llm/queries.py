"""The registered queries of this folder: ``QUERIES`` and their DuckDB SQL ``ORACLE_SQL``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm import (decontaminate, html_extract, near_dedup, prefix_trie, quality, secret_scan, sentencepiece_codec,
                          sharding, substring_dedup, token_counts, url_filter, warc, word_runs)
from carepath.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.report(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.default_list(spark))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), changed_only=True)
    return cut.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "kept_in",
                      F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_url_filters, op3_html_extraction, op4_sharding, op5_secret_scans, op6_near_dedup,
    op7_decontamination, op8_quality_rules, op9_warc, op10_substring_dedup,
    op11_prefix_trie, op12_token_counts, op13_word_runs)}

ORACLE_SQL = {"op2_url_filters": url_filter.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL,
              "op11_prefix_trie": prefix_trie.ORACLE_SQL}
