"""A cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Language identification drops documents without a recognisable language; the n-gram Jaccard join
keeps one document of each group of near copies; decontamination drops documents that hold a passage
of a benchmark item; the secret scan replaces secrets in the texts; mixing takes documents as often as
their source's target asks for, and adds which copy a row is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcwindow.llm import decontaminate, jaccard, language, mixing, secret_scan
from arcwindow.plans.scratch import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whose language is predicted with a score of 0.5 or more."""
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8, the one of smallest id."""
    return jaccard.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<secret>`` in place of secrets and ``n_chars`` counted anew where text changed."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies the mix takes of each document, numbered by ``copy``."""
    return mixing.take_copies(docs, mixing.mix(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("near_copies", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("mixing", mixed),
]

#: SQL has no counterpart of the trained language model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
