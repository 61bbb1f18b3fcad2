"""Connected components of links between documents, and ids that are not unique."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from arcwindow.plans.scratch import cut_lineage


#: Rows of a batch of texts that is handed to Python.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> None:
    """Let the session hand whole texts to Python in batches that fit beside each other into a small executor."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def one_text_per_id(documents: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, text`` of rows with an id, and whether ids were unique; else the smallest text of an id counts."""
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        return rows.groupBy("doc_id").agg(F.min("text").alias("text")), False
    return rows, True


def packed(texts: DataFrame, *more: str, asked: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``doc_id, more.., z``: texts compressed one by one, for shuffling; of those whose id's hash is ``asked``."""
    names = ["doc_id", *more]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if asked is not None:
                batch = batch.filter(pa.array(asked(batch["hash"].to_numpy())))
            z = pa.array([press.compress((t.as_py() or "").encode()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], z], names=[*names, "z"])

    kinds = dict(texts.dtypes)
    rows = texts.select(*names, "text", *([] if asked is None else [F.xxhash64("doc_id").alias("hash")]))
    return rows.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in names) + ", z binary")


#: Links that one task contracts.
LOCAL = 1_000_000


def contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """Links ``u, v`` to the smallest id that the links of a task reach, and how many tasks there were."""
    tasks = max(1, -(-links.count() // LOCAL))
    kind = dict(links.dtypes)["u"]

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        u, v = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = np.split(place.reshape(-1), 2)
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (label[a], label[b]):
                np.minimum.at(new, side, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        arrow = held[0].schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], arrow), pa.array(ids[label[moved]], arrow)], names=["u", "v"])

    return cut_lineage(links.coalesce(tasks).mapInArrow(contract, f"u {kind}, v {kind}")), tasks


def components(links: DataFrame) -> DataFrame:
    """``id, component``: for all linked ids the smallest id that links reach.

    ``links`` has two id columns ``a, b``. Every task first contracts the links it has, ``LOCAL`` about; if they are more,
    rounds of large stars and small stars follow (Kiveris et al., "Connected components in MapReduce and
    beyond"): every id's larger neighbours move to its smallest neighbour, then its smaller ones do. Each round
    writes its links, and joins on ids whose many neighbours Spark can split; neighbours are never gathered.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    edges, tasks = contracted(edges)
    before = None
    while tasks > 1:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(moved.where("u <> v").distinct())
    # every id but the smallest has one link, to the smallest
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def roots(links: np.ndarray) -> np.ndarray:
    """For every place of a symmetric matrix of links the smallest place it is connected with."""
    label = np.arange(len(links))
    while True:
        best = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new
