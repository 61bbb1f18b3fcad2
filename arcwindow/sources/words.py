"""Word lists: one entry per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwindow.operators.order import row_numbers
from arcwindow.plans.scratch import cut_lineage

# The three ways in which entries are stripped.
STRIP = {
    "ws": "[ \\t\\n\\r\\x0b\\f]",  # any ASCII whitespace, both ends
    "spacetab": "[ \\t\\n]",  # spaces, tabs and line feeds, both ends
    "newline": "\\n",  # the line end only
}


def read_words(spark: SparkSession, path: str, strip: str = "ws") -> DataFrame:
    """``word, id`` where id is the line number from 0.

    A list is a file, or a folder of files in the order of their names; files are cut anywhere, and lines are
    numbered over them. Entries keep their duplicates (see ``operators.vocabulary``).
    """
    if strip not in STRIP:
        raise ValueError(f"strip is one of {tuple(STRIP)}")
    space = STRIP[strip]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", rf"\A{space}+|{space}+\z", "").alias("word"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered = row_numbers(cut_lineage(lines), ["file", "block", "line"], "id")
    return numbered.select("word", (F.col("id") - 1).alias("id"))
