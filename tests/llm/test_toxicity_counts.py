"""Toxicity counts come from all labelled rows, not from a sample."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from arcwindow.llm import labelled, toxicity
from tests.llm.conftest import documents, is_held_out, prose


def test_counts_of_all_rows(spark, monkeypatch):
    rng = random.Random(31)
    texts = [None, "", "a", *(prose(rng, rng.randint(1, 80)) for _ in range(60))]
    monkeypatch.setattr(toxicity, "GATHERED", 500)
    rows = documents(spark, texts).selectExpr("CAST(doc_id % 2 AS int) AS label", "text").repartition(5)
    got = {(r["label"], r["code"]): r["n"] for r in toxicity.class_counts(rows).collect()}
    want = Counter()
    for i, text in enumerate(texts):
        data = toxicity.formed([(text or "").encode()]).tobytes()
        want.update((i % 2, int.from_bytes(data[k : k + 6], "big")) for k in range(1, len(data) - 5))
    assert got == want


def test_the_rarest_are_left_out_beyond_the_bound(spark):
    rows = [(0, i, 1 + i // 10) for i in range(40)] + [(1, i, 5) for i in range(3)]
    found = toxicity.commonest(spark.createDataFrame(rows, "label int, code bigint, n bigint"), 25)
    assert found[0][0].tolist() == list(range(20, 40)) and found[1][0].tolist() == [0, 1, 2]


def test_expressions_outside_the_sample_are_learnt(spark):
    """Few toxic rows hold the insult, and they are long, or not chosen for the sample."""
    rng = random.Random(32)
    texts = []
    for i in range(400):
        words = prose(rng, 40).split()
        if i % 2:
            words[7:7] = ["zounds"] if i % 8 == 1 else ["stinking", "liar"]
        texts.append(" ".join(words))
    long = [i for i in range(400) if i % 8 == 1]
    for i in long:
        texts[i] += " " + prose(rng, 8000)
        assert len(texts[i]) > labelled.TEXT_BYTES
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    assert sum(not is_held_out(i, 4, 2) for i in long) > 10
    model = toxicity.learn(documents(spark, texts), labels, "toxic", 4, 2, per_class=40)
    codes = np.array([int.from_bytes(w, "big") for w in (b"zounds", b"liarqq")], dtype=np.uint64)
    known, ratio, _ = model.tables[6](codes)
    assert known.tolist() == [True, False] and ratio[0] > 1


def test_tables_grow_with_the_counts():
    codes = np.arange(1, 1 << 20, dtype=np.uint64) * np.uint64(977)
    zeros = np.zeros(len(codes))
    table = toxicity.Table.of(4, codes, zeros, zeros, zeros)
    assert table.bits == 22 and table(codes)[0].mean() > 0.85


def labelled_texts(n: int) -> tuple[list[str], list[int]]:
    rng = random.Random(33)
    texts, toxic = [], [i % 2 for i in range(n)]
    for i in range(n):
        words = prose(rng, 60).split()
        if toxic[i]:
            words[5:5] = rng.choice(["wretched fool", "stinking liar", "Vile dog, 12 toads"]).split()
        texts.append(" ".join(words) * (30 if i == 7 else 1))
    return [*texts, "", "a"], toxic


def test_a_model_in_parts_scores_like_a_whole_one(spark, monkeypatch):
    """No sequence is left out where a class has more of them than a part holds."""
    texts, toxic = labelled_texts(160)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    whole = toxicity.learn(documents(spark, texts), labels, "toxic", 4, 2, per_class=40)
    parts = toxicity.learn(documents(spark, texts), labels, "toxic", 4, 2, per_class=40, most=300)
    assert len(whole.parts) == 1 and len(parts.parts) > 5
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 3000)
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 8000)
    coded = [t.encode() for t in texts]
    assert np.allclose(whole.evidence(coded), parts.evidence(coded), atol=1e-4) and np.allclose(whole.weights, parts.weights, atol=1e-4)
    monkeypatch.setattr(toxicity, "learn", lambda *_: parts)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(documents(spark, texts), labels).collect()}
    want = labelled.on_curve(whole.evidence(coded), whole.weights)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)


def test_every_sequence_of_the_labelled_rows_is_known(spark):
    """Also those that meet others in a slot, and the rarest beyond what the driver takes at once."""
    codes = np.unique(np.random.default_rng(5).integers(1, 1 << 48, 400_000, dtype=np.uint64))
    ratio = np.linspace(-3, 3, len(codes))
    table = toxicity.Table.of(6, codes, np.ones(len(codes)), ratio, -ratio)
    known, r, b = table(codes)
    assert known.all() and np.abs(r - ratio).max() < 0.01 and np.abs(b + ratio).max() < 0.01
    others = np.setdiff1d(codes + np.uint64(1), codes)
    assert not table(others)[0].any()
