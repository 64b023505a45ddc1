"""The corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capstrata.llm import jaccard, linededup, mixing, quality
from capstrata.llm.common import table
from capstrata.llm.queries import MIX_SEED, MIX_WEIGHTS, packed
from capstrata.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates of the pipeline: five words, a similarity of 0.8 or more.
NEAR_RULE = jaccard.JaccardRule(words=5, num=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest, which is calibrated on `labels`."""
    stats = stage(quality.rule_statistics(docs.select("doc_id", "text"), "text").drop("text"))
    model = quality.fit_quality(stats, table(spark, sf_dir, "labels"), "doc_id", "quality")
    return quality.keep_good(docs.select(*COLUMNS), "text", model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; a document of such lines only goes."""
    return linededup.drop_repeated(docs, "doc_id", "text").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs, "doc_id", "text", NEAR_RULE).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their weights, in global random order."""
    return mixing.mix_sources(docs, "source", ["doc_id"], "text", MIX_WEIGHTS, seed=MIX_SEED).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The first stage fits a model, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
