"""Trained operators: held-out accuracy on the given tables, and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwindow.llm import labelled, language, quality, toxicity
from arcwindow.llm.queries import QUERIES
from tests.llm.conftest import documents, is_held_out, prose

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_held_out_rows(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id bigint")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", labelled.held_out(4, 2).alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {i: is_held_out(i, 4, 2) for i in got}


def test_samples_leave_held_out_rows_alone(spark, labels):
    known = {r["doc_id"] for r in labels.collect()}
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("text", F.col("doc_id").cast("string"))
    sample = labelled.labelled_sample(texts, labels, "quality", 4, 2)
    ids = {int(t) for _, t in sample}
    assert ids and ids <= known and not any(is_held_out(i, 4, 2) for i in ids)
    few = labelled.labelled_sample(texts, labels, "quality", 4, 2, per_class=20)
    assert {y for y, _ in few} == {0, 1} and len(few) < 90


@pytest.mark.parametrize("name, label, least", [("op8_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, labels, name, label, least):
    scored = QUERIES[name](spark, SF_DIR)
    assert scored.count() == 1000
    row = scored.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col(label)).cast("double")), F.min("score"), F.max("score")
    ).first()
    assert row[0] >= least and 0 <= row[1] <= row[2] <= 1


def test_held_out_languages(spark):
    predicted = QUERIES["op10_language"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    assert predicted.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores], ids=["quality", "toxicity"])
def test_scores_of_odd_and_empty_tables(spark, odd_documents, no_documents, scores):
    label = "quality" if scores is quality.quality_scores else "toxic"
    rows = [(i, i % 2) for i in range(10)] + [(3, None), (None, 1), (4, 7)]
    few = spark.createDataFrame(rows, f"doc_id bigint, {label} int")
    got = scores(odd_documents, few, label)
    assert got.columns == ["doc_id", "held_out", "score"] and got.count() == odd_documents.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scores(no_documents, few, label).count() == 0
    for known in (few.where("false"), few.where(f"{label} = 1"), few.where(f"{label} = 0")):
        assert {r["score"] for r in scores(odd_documents, known, label).collect()} == {0.0}


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores], ids=["quality", "toxicity"])
def test_scores_of_text_ids(spark, scores):
    table = spark.createDataFrame([(f"d{i}", ("fine words " if i % 2 else "vile mess ") * 20) for i in range(80)], "doc_id string, text string")
    known = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)], "doc_id string, label int")
    got = scores(table, known, "label").join(known, "doc_id").groupBy("label").agg(F.avg("score"))
    assert dict(got.collect())[1] > dict(got.collect())[0]


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(21)
    good = [prose(rng, 60) for _ in range(120)]
    bad = [" ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()) for _ in range(120)]
    model = quality.fit([(1, t) for t in good[:80]] + [(0, t) for t in bad[:80]])
    sizes = quality.Sizes(model.good, model.bad)
    score = lambda t: labelled.on_curve(np.array([[sizes(t)]]), model.weights)[0]
    assert min(map(score, good[80:])) > 0.5 > max(map(score, bad[80:]))


def test_toxicity_finds_one_insult_in_a_long_text():
    rng = random.Random(22)
    insults = ["wretched fool", "stinking liar"]
    rows = []
    for i in range(300):
        words = prose(rng, 60).split()
        if i % 3 == 0:
            words[rng.randint(0, 59)] = rng.choice(insults)
        rows.append((int(i % 3 == 0), " ".join(words)))
    model = toxicity.fit(rows)
    clean = prose(rng, 2000)
    one = clean[:5000] + " wretched fool " + clean[5000:]
    a, b = labelled.on_curve(model.evidence([one.encode(), clean.encode()]), model.weights)
    assert a > b and a > 0.5


def test_toxicity_slots_hold_what_they_are_given():
    codes = np.arange(1, 400, dtype=np.uint64) * np.uint64(977)
    ratio, backoff = np.linspace(-3, 3, len(codes)), np.linspace(1, -1, len(codes))
    table = toxicity.Table.of(5, codes, np.ones(len(codes)), ratio, backoff)
    known, r, b = table(codes)
    assert known.mean() > 0.99 and np.abs(r - ratio)[known].max() < 0.01 and np.abs(b - backoff)[known].max() < 0.01
    assert not table(codes + np.uint64(10**9))[0].any()


def test_probabilities_sum_to_one():
    data = toxicity.formed([b"the red car is red", b"a red house"])
    orders = toxicity.class_orders(data)
    low = np.full(256, 1 / 256)
    for context in (b" red", b"the ", b"zzzz"):
        code = np.uint64(int.from_bytes(context[-3:], "big") << 8)
        p = orders[4].probability(code + np.arange(256, dtype=np.uint64), low)
        assert p.sum() == pytest.approx(1.0)


def test_languages_of_odd_and_empty_tables(spark, odd_documents, no_documents):
    got = {r["doc_id"]: r for r in language.identify(odd_documents).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert got[3]["lang_pred"] == "en" and 0 < got[3]["score"] <= 1
    kept = language.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and kept.where("doc_id IN (0, 1, 2)").count() == 0
    assert kept.where("doc_id IN (3, 4, 5, 6)").count() == 4
    assert language.identify(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_counts_come_from_all_chosen_rows(spark):
    rng = random.Random(23)
    texts = [prose(rng, 20) for _ in range(40)] + ["le rouge et la verte maison des rivières " * 3] * 40
    model = language.learn(documents(spark, texts, lang=["en"] * 40 + ["fr"] * 40))
    names, scores = model.predict(language.Features(), ["la maison verte", "the red house", "1234", ""])
    assert names == ["fr", "en", "und", "und"] and scores[2] == scores[3] == 0
