"""Time the headline queries and print one JSON line.

Every query runs to its last row into a sink that keeps nothing. ``BENCH_SF_DIR`` names the
tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arcwindow.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "unigram_window_counts",
    "dependency_window_counts",
    "linear_runs",
    "combined_counts",
    "whole_sentence_profile",
    "phrase_sentence_profile",
    "text_window_counts",
    "listed_row_col_counts",
    "grep_intersection",
    "trim_by_pattern",
    "noun_heads",
    "words_of_sentences",
    "graphs",
    "parts_by_sentences",
    "union_counts",
    "corpus_counts",
    "phrase_run_counts",
    "text_file_counts",
    "phrase_groups",
    "encoded_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # the tables of the bench are one block each
        .config("spark.arcwindow.inputPartitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        # call sites of every column expression are for debugging; they slow plans down
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # warm the JVM up
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
