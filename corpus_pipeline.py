"""A training corpus from documents: five stages, each over all rows that the one before it kept.

Toxic documents go, lines that ten or more documents share go, one document of each near-duplicate class stays,
documents that hold benchmark items go, and the rest is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import linedup, neardup, packing, tiling, toxicity
from cuelake.llm.jobfolder import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the network learns from all labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, bar=0.7), bar=0.7)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    return linedup.without_common_lines(docs, min_docs=10, least_chars=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are 0.8 or more alike."""
    return neardup.one_of_each(docs, least=0.8)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return tiling.without_leaks(docs, items, seed_words=4, coverage=0.6)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of the kept documents lies in sequences of 1024."""
    return packing.pack(docs, size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack_sequences),
]

#: Trained scores and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
