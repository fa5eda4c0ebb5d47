"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination, packing.

Every stage works on all rows that the one before kept and returns them with the columns of documents;
the last one returns the packed pieces. ``run`` writes each stage to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecbench.llm.common import settle, table
from vecbench.llm.decontaminate import drop_contaminated
from vecbench.llm.minhash import keep_one
from vecbench.llm.packing import Capacity, pack
from vecbench.llm.quality import keep_good
from vecbench.llm.tokens import vocabulary
from vecbench.llm.toxicity import drop_toxic

#: SQL has no hash, tokenizer or classifier of these stages: tests/llm checks run() by brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (operator 5)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go (operator 8)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 10)."""
    return keep_one(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go (operator 1)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), containment=0.75)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row a piece (operator 2)."""
    return pack(docs, vocabulary(), Capacity(tokens=2048), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
