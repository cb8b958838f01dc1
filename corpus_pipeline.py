"""Corpus pipeline over ``documents``: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents, but for the last, which returns packed
pieces.  Outputs are written as Parquet to the shared checkpoint folder and read
again between stages, so a lost executor never repeats an earlier stage; the
tables that a stage needed on its way are deleted when its output stands.

All stages: a null text is empty and stays (of several, one), null and repeated
ids are rows like others and go for their own text only, empty tables stay
empty, and further columns pass through whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from chronorel.llm.common import settle, table
from chronorel.llm.decontaminate import drop_contaminated
from chronorel.llm.exact_dedup import drop_exact_copies
from chronorel.llm.near_dedup import drop_near_copies
from chronorel.llm.packing import pack
from chronorel.llm.queries import tokenizer_path
from chronorel.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at similarity 0.8 the smallest id stays."""
    return drop_near_copies(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain 0.8 of a benchmark item's 5-word shingles go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The first and third stage rest on a trained model and on graph components; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
