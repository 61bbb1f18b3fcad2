"""Registered queries of the training-corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwindow.llm import (
    alignment,
    caps,
    decontaminate,
    jaccard,
    language,
    mixing,
    negatives,
    quality,
    secret_scan,
    shards,
    suffixes,
    token_counts,
    toxicity,
)
from arcwindow.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each text without strings of 100 bytes that start earlier too."""
    kept = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.KINDS],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label."""
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by benchmark windows, and the items that occur."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary file lies; every executor has it there."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Bytes and tokens of each text."""
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary or vocabulary_file(BYTE_BPE))
    return counted.select("*", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of similar documents."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores."""
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores."""
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages."""
    return language.identify(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh counts with the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; the operator's rows here are without texts."""
    documents = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shards.sharded(slim, "doc_id")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and piece tokens of each text."""
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE), vocabulary_file(PIECE_BPE))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_duplicates": op4_embedding_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_feistel_sharding": op12_feistel_sharding,
    "op13_token_alignment": op13_token_alignment,
}
