"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and all else is a space; pairs and triples of characters are hashed into
``BUCKETS``. Counts per language come from Spark, over about ``PER_LANGUAGE`` documents of each
language that are chosen by hash. The matrix of log-probabilities, buckets by languages, goes to
all tasks; its size is bounded by the two numbers and the number of languages. Tasks score whole
texts in batches: the matrix rows of all n-grams are summed up by text.

The score is the posterior of the predicted language, with evidence of at most ``TRUST`` n-grams,
since n-grams of a text are far from independent.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is all when
there is nothing to learn from; rows without language or id are not learnt from, those without id
are not held out; repeated rows stay; columns other than ``doc_id, text, lang`` are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwindow.llm.labelled import hashed_share, held_out
from arcwindow.llm.textbytes import BASE, PIECE_BYTES

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE = 1500
SMOOTHING = 0.1
TRUST = 30
UNKNOWN = "und"
SPACE = 32


def letter_table() -> np.ndarray:
    """The code point itself for letters, a space for all else."""
    table = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint32)
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    table[letters] = letters
    return table


class Features:
    """Buckets of the n-grams of texts."""

    def __init__(self) -> None:
        self.letters = letter_table()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``buckets, rows, has a letter``; the n-grams of a row are those that hold a letter."""
        joined = "  " + "".join(t.lower() + "  " for t in texts)
        codes = self.letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
        wide = codes.astype(np.uint64)
        pair = wide[1:-1] << np.uint64(21) | wide[2:]
        triple = wide[:-2] << np.uint64(42) | pair
        is_letter = codes != SPACE
        two = is_letter[1:-1] | is_letter[2:]
        three = two | is_letter[:-2]
        has = np.bincount(rows[is_letter[2:]], minlength=len(texts)) > 0
        grams = np.concatenate([pair[two], triple[three] | np.uint64(1 << 63)])
        return hashed(grams), np.concatenate([rows[two], rows[three]]), has


def hashed(grams: np.ndarray) -> np.ndarray:
    h = grams * np.uint64(BASE)
    h ^= h >> np.uint64(31)
    h *= np.uint64(BASE)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def text_pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def predict(self, features: Features, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for first, last in text_pieces(texts):
            buckets, rows, has = features(texts[first:last])
            n = np.bincount(rows, minlength=last - first)
            sums = np.stack(
                [np.bincount(rows, weights=column[buckets], minlength=last - first) for column in self.matrix], axis=1
            )
            sums = sums * (np.minimum(n, TRUST) / np.maximum(n, 1))[:, None] + self.prior
            odds = np.exp(sums - sums.max(axis=1, keepdims=True))
            best = sums.argmax(axis=1)
            names += [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
            scores.append(np.where(has, odds.max(axis=1) / odds.sum(axis=1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def learn(documents: DataFrame, folds: int = 3, fold: int = 1) -> Model | None:
    """Fit the model on documents that are not held out."""
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, PER_LANGUAGE / n)]), F.col("lang"))
    chosen = known.where(hashed_share(share, "doc_id")).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, totals = Features(), {}
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for first, last in text_pieces(texts):
                buckets, rows, _ = features(texts[first:last])
                piece = np.array(langs[first:last])
                for lang in set(langs[first:last]):
                    total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    total += np.bincount(buckets[(piece == lang)[rows]], minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    table = chosen.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(counts)
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    for row in table.toLocalIterator():  # no more rows than the matrix has places
        matrix[place[row["lang"]], row["bucket"]] += row["n"]
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    of_lang = np.array([counts[lang] for lang in languages], dtype=float)
    return Model(languages, matrix, np.log(of_lang / of_lang.sum()))


def predictions(model: Model | None, texts: list[str | None], features: Features) -> tuple[list[str], np.ndarray]:
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    return model.predict(features, [t or "" for t in texts])


def identify(documents: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``."""
    model = learn(documents, folds, fold)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            names, scores = predictions(model, batch["text"].to_pylist(), features)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select("doc_id", held_out(folds, fold).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, least: float = 0.5, folds: int = 3, fold: int = 1) -> DataFrame:
    """The documents whose language is known and predicted with a score of at least ``least``, all columns."""
    model = learn(documents, folds, fold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            names, scores = predictions(model, batch["text"].to_pylist(), features)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
