"""The ``opN_`` queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.llm import chat, decontam, html_main, langid, lm, quality, segment, shard, simhash, toxicity
from ketflow.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learns(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~toxicity.learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, N-best scores and exact round trip of every document."""
    return segment.round_trip(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard.shard(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = chat.canonical_turns(rows).unionByName(chat.canonical_turns(own))
    return chat.digest(chat.format_turns(turns))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = html_main.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"), langid.learns(F.col("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (~langid.learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all documents."""
    done = lm.score(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", "n_backoff", (F.round("log_score", 4) + 0.0).alias("log_score"), (F.round("mean_log_score", 6) + 0.0).alias("mean_log_score"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.matches(docs, table(spark, sf_dir, "benchmark")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and rule verdict of every document."""
    return quality.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_sharding": op4_sharding,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_html_extraction": op6_html_extraction,
        "op7_language_id": op7_language_id,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": chat.oracle(),
        "op6_html_extraction": html_main.oracle(),
        "op8_lm_scoring": lm.oracle(),
        "op9_benchmark_decontamination": decontam.oracle(),
        "op10_quality_rules": quality.oracle(),
    }
