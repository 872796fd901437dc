"""The queries of this package, by name, and the SQL that states some of them for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, materialise, oracles, packing, quality, simhash, substring, toxicity, url_filter, warc
from .common import table


#: The rules of the contract, and hosts known for spam where no rule fits.
BLOCK_RULES, ALLOW_RULES = ["com/en/", "example.net/de/8", "org/es/"], ["example.com/en/7", "net/de/"]
SPAM_HOSTS = ["cheap-pills.example.com", "spam-farm.example.org"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.write_shards(table(spark, sf_dir, "documents"), special=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.fails_policy("base").alias("base_failed"),
        (~quality.fails_policy("v1")).alias("kept"),
        F.col("failed").cast("long").alias("failed_rules"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), special=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_decontaminate, op4_toxicity, op5_quality_rules, op6_training_order, op7_html_text, op8_warc, op9_simhash, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": oracles.url_filter(BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS),
        "op3_decontaminate": oracles.DECONTAMINATE,
        "op5_quality_rules": oracles.QUALITY,
        "op8_warc": oracles.WARC,
    }
