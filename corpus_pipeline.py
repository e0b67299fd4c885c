"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's documents.  All stages but the last return the
columns of the documents they were given, and the rows they keep.  An empty table
passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.llm import decontam, langid, segment, simhash, toxicity
from ketflow.llm.common import columns_of, materialize, table

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some confidence and that fit it: the posterior alone only compares the learnt languages."""
    model = langid.train(docs, langid.learns(F.col("doc_id")))
    told = langid.predict(docs, model, out="__lang_pred", out_score="__lang_score", out_known="__lang_known")
    return told.filter((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= MIN_LANGUAGE_SCORE) & F.col("__lang_known")).select(*columns_of(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learns(F.col("doc_id")))
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: fingerprints linked by BK-trees, then an exact test (five-word shingles, similarity 0.8 or more)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window."""
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), out="__found")
    return found.filter(F.size("__found.items") == 0).select(*columns_of(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document: id, number and digest of the best segmentation, N-best scores, exact round trip."""
    return segment.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Trained models and tries are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
