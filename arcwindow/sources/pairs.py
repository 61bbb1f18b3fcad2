"""Pair streams: ``target \\t context`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BAD_LINES = ("drop", "fail")


def _split_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.split("value", "\t", -1).alias("_f")
    )


def read_pairs(spark: SparkSession, paths, on_bad_line: str = "drop") -> DataFrame:
    """``target, context``; a line of other than two fields is dropped or ends the job."""
    if on_bad_line not in BAD_LINES:
        raise ValueError(f"on_bad_line is one of {BAD_LINES}")
    lines = _split_lines(spark, paths)
    good = F.size("_f") == 2
    if on_bad_line == "fail":
        complaint = F.concat(F.lit("bad pair line: "), F.col("value"))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return lines.where(good).select(
        F.get("_f", F.lit(0)).alias("target"), F.get("_f", F.lit(1)).alias("context")
    )


def bad_pair_lines(spark: SparkSession, paths) -> DataFrame:
    """The lines ``read_pairs`` drops, with their field count."""
    return (
        _split_lines(spark, paths)
        .where(F.size("_f") != 2)
        .select(F.size("_f").alias("n_fields"), F.col("value").alias("line"))
    )
