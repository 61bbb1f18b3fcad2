"""Small tables for the operators, with nulls, empty texts, repeats, ties and clashing columns."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and in to is red car sold house tree river stone light dark green seven eight nine ten".split()
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(spark: SparkSession, texts: list[str | None], **columns) -> DataFrame:
    """Documents 0, 1, 2, ... with these texts; other columns by name."""
    rows = [
        (
            i,
            text,
            columns.get("lang", ["en"] * len(texts))[i],
            columns.get("source", ["a"] * len(texts))[i],
            len(text or ""),
        )
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def is_held_out(doc_id: int, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Null, empty, blank, one word, a very long one, the same twice, and signs beyond ASCII."""
    rng = random.Random(3)
    long = prose(rng, 6000)
    return [None, "", "   \n\t ", "word", long, long, "x" * 30_000, "ß é 漢字 😀   z\x00z", prose(rng, 40), prose(rng, 40)]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts) -> DataFrame:
    """The odd texts, a repeated row, a row without id, and columns whose names operators use."""
    plain = documents(spark, odd_texts, source=[None, "a", "b", "b", "a", "c", "c", "a", "a", None])
    more = spark.createDataFrame([(9, odd_texts[9], "en", None, 5), (None, odd_texts[4], None, "b", 7)], DOCUMENTS)
    return plain.unionByName(more).selectExpr(
        "*", "'clash' AS size", "1 AS spans", "2 AS key", "3 AS n", "'q' AS score", "0 AS component_id", "'k' AS _key", "9 AS copies"
    )


@pytest.fixture(scope="session")
def no_documents(spark) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)
