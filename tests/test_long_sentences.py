"""Flags of listed words and heads of trimmed sentences: time grows with a sentence, not with its square."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from arcwindow.functions.tokens import LINE_FIELDS, TOKEN_COLUMNS
from arcwindow.operators import filters
from arcwindow.operators.trim import DANGLING, Pivots, trim
from arcwindow.sources.annotated import annotated_sentences


@pytest.mark.parametrize("looked_up", [0, 1 << 12])
def test_flags_either_way(spark, monkeypatch, looked_up):
    monkeypatch.setattr(filters, "LOOKED_UP", looked_up)
    rng = random.Random(1)
    rows = []
    for i in range(60):
        texts = [rng.choice([None, "", "a", "ab", "é", str(rng.randint(0, 30))]) for _ in range(rng.randint(0, 40))]
        hits = {t for t in texts if t is not None and rng.random() < 0.5} | {"q"}
        rows.append((i, texts, None if i % 9 == 0 else sorted(hits)))
    df = spark.createDataFrame(rows, "i int, texts array<string>, hits array<string>")
    got = df.select("i", filters.marked(F.col("texts"), F.col("hits")).alias("f")).collect()
    assert dict(got) == {i: [t is not None and t in (hits or []) for t in texts] for i, texts, hits in rows}


def long_sentence(spark, n: int):
    """Words 1 to n, every third listed, each with the word after it as head."""
    ids = F.sequence(F.lit(1), F.lit(n))
    columns = {
        "id": F.transform(ids, lambda i: i.cast("string")),
        "dep_id": F.transform(ids, lambda i: (i % n + 1).cast("string")),
        **{f: F.transform(ids, lambda i: F.concat(F.lit("w"), i.cast("string"))) for f in ("word", "lemma", "pos", "dep_rel")},
    }
    row = spark.range(1).select("id", *[columns[f].alias(f"tok_{f}") for f in LINE_FIELDS])
    none = [F.lit(None).cast(t).alias(c) for t, c in zip(("array<string>", "array<int>"), TOKEN_COLUMNS[-2:])]
    return row.select("*", *none, F.filter("tok_lemma", lambda w: F.substring(w, 2, 9).cast("int") % 3 == 0).alias("_hits"))


def trimmed(spark, n: int):
    sentence = long_sentence(spark, n)
    known = filters.marked(F.col("tok_lemma"), F.col("_hits"))
    kept = trim(sentence.withColumn("known", known).drop("_hits"), Pivots(flag_column="known"))
    start = time.monotonic()
    row = kept.select("tok_word", "tok_id", "tok_dep_id").head()
    return row, time.monotonic() - start


def test_long_sentences(spark):
    n = 60_000
    trimmed(spark, 1000)
    row, seconds = trimmed(spark, n)
    assert row.tok_word == [f"w{i}" for i in range(3, n + 1, 3)]
    assert row.tok_id == [str(i) for i in range(1, n // 3 + 1)]
    assert set(row.tok_dep_id) == {str(DANGLING)}
    assert seconds < 20


def test_tags_are_made_once(spark):
    """Relations are made of the tags of a sentence, not of tags of their own."""
    texts = spark.createDataFrame([(1, "nation walking")], "doc_id bigint, text string")
    both = annotated_sentences(texts, ["doc_id"]).select("tok_pos", "tok_dep_rel")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("VVG") == 1
    row = both.first()
    assert row.tok_pos == ["NN", "VVG"] and row.tok_dep_rel == ["ROOT", "DEP"]
