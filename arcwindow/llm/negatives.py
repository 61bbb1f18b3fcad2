"""Hard negatives of anchors among all vectors, by Four-Russians scoring.

Components are whole numbers. For each group of eight dimensions of an anchor a table holds the sums of all 256
subsets of its eight components. A candidate's components are kept as bit planes, a byte for each group and
plane. A plane's part of the inner product is the sum of the groups' table entries at those bytes; planes
are put together from the highest down, doubling in between (the highest one counts negative, as in two's
complement). That is the full exact inner product, without a multiplication.

All anchors meet all rows, block by block. Rows are numbered by label and id, and so many numbers in a row make
a block, which is one row of a table; so a label that a third of all rows has fills many blocks, and rare labels share
one. Positives come from the pairs of blocks that have a label in common. With their scores known, negatives come
from the pairs of blocks that differ in a label. A task scores a pair of blocks at a time and puts out no more than the best
few of each anchor in it; a ranked window keeps the best of those. Nothing is broadcast.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows
without an id; of rows that share an id the least (label, vector) counts; vectors of different lengths are filled up with
zeros; whole components beyond +-2^20 count as that; anchors without a positive, and positives without a
negative in range, give no row; ties go to the smaller id; an empty table gives an empty result; other columns are
ignored. Ids and labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arcwindow.operators.order import row_numbers
from arcwindow.plans.scratch import cut_lineage

GROUP = 8
#: Candidates and anchors of a block.
CANDIDATES = 2048
ANCHORS = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score as percent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
LARGEST = 1 << 20
NONE = np.iinfo(np.int64).min


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """``tables[group, subset, anchor]`` for anchors as rows; bit ``i`` of a subset is dimension ``i`` of its group."""
    groups = anchors.shape[1] // GROUP
    tables = np.zeros((groups, 1 << GROUP, len(anchors)), dtype=dtype)
    for i in range(GROUP):
        one = 1 << i
        tables[:, one : 2 * one] = tables[:, :one] + anchors.T.reshape(groups, GROUP, 1, -1)[:, i]
    return tables


def bit_planes(components: np.ndarray, planes: int) -> np.ndarray:
    """``bytes[plane, group, row]`` of whole numbers in two's complement."""
    bits = (components[None] >> np.arange(planes)[:, None, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed.transpose(0, 2, 1))


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``score[candidate, anchor]``: table lookups, shifted and added."""
    total = np.zeros((planes.shape[2], tables.shape[2]), dtype=tables.dtype)
    entry = np.empty_like(total)
    for k in range(len(planes) - 1, -1, -1):
        total <<= 1
        for table, subset in zip(tables, planes[k]):
            np.take(table, subset, axis=0, out=entry)
            if k == len(planes) - 1:
                total -= entry
            else:
                total += entry
    return total


class Candidates:
    """A block of rows: ids, labels and bit planes."""

    def __init__(self, row: dict, planes: int) -> None:
        self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        self.planes = np.frombuffer(row["data"], dtype=np.uint8).reshape(planes, -1, len(self.ids))
        self.by_id = np.argsort(self.ids)
        self.place = np.empty(len(self.ids), dtype=np.int64)
        self.place[self.by_id] = np.arange(len(self.ids))

    def best(self, total: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``anchor, candidate's id, score`` of the first, second.. wanted candidate of each anchor."""
        n = len(self.ids)
        rank = np.where(wanted, total.astype(np.int64) * n + (n - 1 - self.place)[:, None], NONE)
        columns = np.arange(total.shape[1])
        for _ in range(min(k, n)):
            at = rank.argmax(axis=0)
            top = rank[at, columns]
            some = np.flatnonzero(top != NONE)
            if not len(some):
                return
            yield some, self.ids[at[some]], total[at[some], some].astype(np.int64)
            rank[at, columns] = NONE


class Anchors:
    """A block of anchors: ids, labels, their tables, and the scores of their positives."""

    def __init__(self, row: dict, planes: int, positives: int) -> None:
        self.ids, self.labels = (np.frombuffer(row[f"a_{c}"], dtype=np.int64) for c in ("ids", "labels"))
        components = np.frombuffer(row["a_data"], dtype=np.int32).reshape(len(self.ids), -1)
        largest = int(np.abs(components.astype(np.int64)).sum(axis=1).max()) << planes
        self.tables = subset_sums(components, np.int32 if largest < 1 << 31 else np.int64)
        if row["a_positives"] is not None:
            self.positive_ids, self.positive_scores = np.frombuffer(row["a_positives"], dtype=np.int64).reshape(2, positives, -1)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, whole``: usable rows, one for each id, components as whole numbers."""
    finite = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    whole = F.transform(
        "embedding",
        lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"),
    )
    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    rows = usable.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), whole.alias("whole"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "whole")).alias("v")).select("vec_id", "v.*")


def blocks(rows: DataFrame, size: int, dimensions: int, planes: int = 0, positives: int = 0) -> DataFrame:
    """``block, ids, labels, data, positives``: a row for each ``size`` numbers in a row.

    ``data`` holds bit planes, or the components themselves when ``planes`` is 0.
    """
    dealt = rows.withColumn("block", F.expr(f"(number - 1) div {size}"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "number")
    wide = -(-max(dimensions, 1) // GROUP) * GROUP
    columns = ["block", "vec_id", "label", "whole"] + (["positives"] if positives else [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                whole = np.zeros((len(batch), wide), dtype=np.int32)
                at = batch["whole"].offsets.to_numpy()
                sizes = np.diff(at)
                column = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], sizes)
                whole[np.repeat(np.arange(len(batch)), sizes), column] = batch["whole"].flatten().to_numpy(zero_copy_only=False)
                known = np.zeros((2, positives, len(batch)), dtype=np.int64)
                if positives:  # places without a positive have no id in range and are told by the scores
                    known[1] = NONE
                    for i, held in enumerate(batch["positives"].to_pylist()):
                        for j, one in enumerate(held):
                            known[:, j, i] = one["id"], one["score"]
                ids, labels, block = (batch[c].to_numpy() for c in ("vec_id", "label", "block"))
                cuts = np.flatnonzero(np.diff(block)) + 1
                for first, last in zip([0, *cuts], [*cuts, len(block)]):
                    if last > first:
                        yield block[first], ids[first:last], labels[first:last], whole[first:last], known[:, :, first:last]

        def packed(block: int, held: list[tuple]) -> pa.RecordBatch:
            ids, labels, whole = (np.concatenate([h[i] for h in held]) for i in range(3))
            data = bit_planes(whole, planes) if planes else whole
            known = np.concatenate([h[3] for h in held], axis=2).tobytes() if positives else None
            arrays = [pa.array([x], pa.binary()) for x in (ids.tobytes(), labels.tobytes(), data.tobytes(), known)]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *arrays], names=["block", "ids", "labels", "data", "positives"]
            )

        last, held = None, []
        for block, *part in parts():
            if block != last and held:
                yield packed(last, held)
                held = []
            last = block
            held.append(part)
        if held:
            yield packed(last, held)

    return dealt.select(*columns).mapInArrow(pack, "block bigint, ids binary, labels binary, data binary, positives binary")


BEST = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def best_in_blocks(pairs: DataFrame, candidates: DataFrame, anchors: DataFrame, planes: int, positives: int, negatives: tuple | None) -> DataFrame:
    """The best candidates of each anchor in each pair of blocks ``block, a_block``."""
    held = pairs.join(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]), "a_block").join(candidates, "block")
    # blocks of anchors one after the other, so that their tables are made once in a task
    held = held.repartition("a_block", "block").sortWithinPartitions("a_block", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchors_ = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if row["a_block"] != last:
                    last, anchors_ = row["a_block"], Anchors(row, planes, positives)
                block = Candidates(row, planes)
                total = scores(anchors_.tables, block.planes)
                same = block.labels[:, None] == anchors_.labels[None, :]
                out = []
                if negatives is None:
                    others = same & (block.ids[:, None] != anchors_.ids[None, :])
                    for a, id_, score in block.best(total, others, positives):
                        out.append((anchors_.ids[a], np.zeros_like(id_), np.zeros_like(id_), id_, score))
                else:
                    most, low, high = negatives
                    for p_id, p_score in zip(anchors_.positive_ids, anchors_.positive_scores):
                        there = p_score != NONE
                        p = np.where(there, p_score, 0)
                        fits = ~same & there & (total >= -(-p * low // 100)) & (total <= p * high // 100)
                        for a, id_, score in block.best(total, fits, most):
                            out.append((anchors_.ids[a], p_id[a], p_score[a], id_, score))
                if out:
                    arrays = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BEST.split(", ")])

    wanted = ["a_block", "a_ids", "a_labels", "a_data", "a_positives", "ids", "labels", "data"]
    return held.select(*wanted).mapInArrow(compare, BEST)


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; ``anchor`` tests ``vec_id`` or ``label``. Components count as
    ``floor(scale * x)``. An anchor's positives are its best others of the same label; negatives have
    another label and ``low`` to ``high`` percent of the positive's score.
    """
    rows = cut_lineage(row_numbers(whole_vectors(vectors, scale), ["label", "vec_id"], "number"))
    asked = cut_lineage(row_numbers(rows.where(anchor).drop("number"), ["label", "vec_id"], "number"))
    dimensions, largest = rows.agg(F.max(F.size("whole")), F.max(F.array_max(F.transform("whole", F.abs)))).first()
    dimensions, planes = dimensions or 1, int(largest or 0).bit_length() + 1
    if 2 * planes - 2 + dimensions.bit_length() + CANDIDATES.bit_length() > 62:
        raise ValueError(f"scores of {dimensions} dimensions and {planes - 1} bits do not fit 64 bits")
    candidates = cut_lineage(blocks(rows, CANDIDATES, dimensions, planes).drop("positives"))

    in_block = lambda df, size, c: df.select("label", F.expr(f"(number - 1) div {size}").alias(c))
    labels, a_labels = in_block(rows, CANDIDATES, "block").distinct(), in_block(asked, ANCHORS, "a_block").distinct()
    shared = labels.join(a_labels, "label").select("block", "a_block").distinct()
    found = best_in_blocks(shared, candidates, blocks(asked, ANCHORS, dimensions), planes, positives, None)
    near = ranked(found, ["anchor_id"], positives)
    near = cut_lineage(
        near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    )

    with_positives = asked.join(near, asked["vec_id"] == near["anchor_id"]).drop("anchor_id")
    later = blocks(with_positives, ANCHORS, dimensions, positives=positives)
    span = lambda df, c, *names: df.groupBy(c).agg(F.min("label").alias(names[0]), F.max("label").alias(names[1]))
    a_spans = span(in_block(with_positives, ANCHORS, "a_block"), "a_block", "a_first", "a_last")
    n_blocks = a_spans.agg(F.max("a_block")).first()[0]
    every = F.sequence(F.lit(0), F.lit(-1 if n_blocks is None else n_blocks), F.lit(1)).cast("array<bigint>")
    if n_blocks is None:
        every = F.array().cast("array<bigint>")
    pairs = span(in_block(rows, CANDIDATES, "block"), "block", "first", "last").withColumn("a_block", F.explode(every))
    differ = (F.col("first") != F.col("a_last")) | (F.col("last") != F.col("a_first"))
    pairs = pairs.join(a_spans, "a_block").where(differ).select("block", "a_block")
    found = best_in_blocks(pairs, candidates, later, planes, positives, (negatives, low, high))
    return ranked(found, ["anchor_id", "positive_id", "positive_score"], negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
