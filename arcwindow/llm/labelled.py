"""Labelled rows to learn from: a bounded sample, and the fold that is never learnt from."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of each class, about, and bytes of a text, at most, that a classifier is fitted on.
PER_CLASS = 3000
TEXT_BYTES = 32 << 10
#: Score of every text where labels do not show both classes: nothing is known then, and nothing is marked.
UNKNOWN = 0.0


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a row without id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def hashed_share(share: Column, *keys: str, seed: int = 11) -> Column:
    """True for about this share of the rows, chosen by a hash of their keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 20)) < share * (1 << 20)


def known_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """``doc_id, label`` of all ids that have a label and are not held out."""
    return (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int = PER_CLASS
) -> list[tuple[int, str]]:
    """``(label, text)`` of about ``per_class`` rows of each class, none of them held out, in a fixed order.

    The ids are chosen by hash before any text is read, and only they are broadcast.
    """
    known = known_labels(labels, label, folds, fold)
    counts = dict(known.groupBy("label").count().collect())
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_class / n)]), F.col("label"))
    chosen = known.where(hashed_share(share, "doc_id"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= TEXT_BYTES)
    return [(r["label"], r["text"]) for r in sorted(rows.toLocalIterator(), key=lambda r: (hash_order(r["doc_id"]), r["text"]))]


def hash_order(doc_id: object) -> int:
    """A number by which ids of any type are put in a fixed order."""
    number = doc_id if isinstance(doc_id, int) else int.from_bytes(hashlib.sha256(str(doc_id).encode()).digest()[:8])
    return (number * 0x9E3779B97F4A7C15) % (1 << 64)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve, the last one its offset, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def on_curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    return 1 / (1 + np.exp(-z))
