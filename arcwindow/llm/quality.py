"""Quality scores from compression with two dictionaries.

One zstandard dictionary is built from text labelled good, one from text labelled bad. A text is
cut into blocks, each is compressed with both, and the difference of the compressed sizes over the
length says which of the two it is more like. Half of the sample builds the dictionaries, the other
half turns the difference into a probability.

The model is fitted on about ``PER_CLASS`` rows of each class, and only texts of up to
``TEXT_BYTES``; every text is scored whole. Dictionaries have a fixed size, so what is broadcast
does not grow.

Defined results: a null text is an empty one and gets the score of no difference; without labels of
both classes all scores are ``UNKNOWN``, below every threshold; repeated rows stay; columns other than ``doc_id, text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from arcwindow.llm.labelled import UNKNOWN, held_out, labelled_sample, logistic, on_curve

DICTIONARY_BYTES = 64 << 10
BLOCK = 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves if they are too few to train one."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


class Sizes:
    """Compares what a text takes with either dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = (
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            for d in (good, bad)
        )

    def __call__(self, text: str | None) -> float:
        """How much smaller the bad dictionary makes a text, per byte, than the good one."""
        raw = (text or "").encode()
        difference = sum(len(self.good.compress(b)) - len(self.bad.compress(b)) for b in blocks(raw))
        return difference / max(len(raw), 1)


def fit(sample: list[tuple[int, str]]) -> Model | None:
    halves = [[(y, t.encode()) for y, t in sample[i::2]] for i in (0, 1)]
    if any({y for y, _ in half} != {0, 1} for half in halves):
        return None
    good, bad = (dictionary([t for y, t in halves[0] if y == k]) for k in (1, 0))
    sizes = Sizes(good, bad)
    x = np.array([[sizes(t.decode())] for _, t in halves[1]])
    return Model(good, bad, logistic(x, np.array([y for y, _ in halves[1]], dtype=float)))


def quality_scores(
    documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2
) -> DataFrame:
    """``doc_id, held_out, score``; the score is the probability of label 1."""
    model = fit(labelled_sample(documents, labels, label, folds, fold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model else None
        for batch in batches:
            if sizes is None:
                scores = np.full(len(batch), UNKNOWN)
            else:
                scores = on_curve(np.array([[sizes(t.as_py())] for t in batch["text"]]).reshape(-1, 1), model.weights)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    rows = documents.select("doc_id", held_out(folds, fold).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")

