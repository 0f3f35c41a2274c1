"""Documents through five operators: quality, toxicity, near copies, mixing, tokens.

Every stage is written as Parquet and read again as the documents of the next one. All
but the last return the columns of ``documents``, extra ones too, whatever their names; the
last returns id, ids and digests.

NULL and empty texts fail the quality rules, so they go first. Texts are read whole in every
stage. Copies of a text, and rows that repeat, are near copies: the one with the smallest id
stays. NULL sources are a source, NULL ids are kept until the last stage. Empty tables, and
labels without rows or of one kind only, pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekover.llm import mixing, quality, queries, simhash, toxicity
from weekover.llm.common import fresh, read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    model = toxicity.fitted(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.scored(docs, model, output=score).where(F.col(score) < 0.5).drop(score)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs, queries.SHINGLE_WORDS, queries.DISTANCE)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; sources are weighed by their order."""
    return mixing.repeated(docs, queries.EPOCHS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and digests that show they decode to it."""
    return queries.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing_to_weights),
    ("byte_bpe", byte_bpe),
]

# Learned decisions and tokenizing have no SQL form: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
