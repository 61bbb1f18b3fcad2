"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A filter is a direction; a vector passes it if their inner product reaches ``alpha``. Directions are a
product code: after a random rotation the space is cut into two halves with ``words`` random unit
vectors each, and every pair of code words is a filter. So a vector's filters are decoded as a
list: only pairs of code words whose two products add up to enough are looked at, and never all
filters. Vectors of one label that share a filter are compared by cosine in double precision.

The more vectors the largest label has, the narrower the caps and the longer the code, so that
chance company in a bucket stays rare and a vector passes ``LIST`` filters on average. Measured
recall on the test vectors is given in the README.

Equal vectors are collapsed first and count with their number. Buckets are cut into blocks, and
pairs of blocks are compared as matrices; what leaves a task are numbers of links and a tree of
links per block pair, never the pairs. A pair that shares several filters is counted in the
smallest of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and
those without label or id have no links and are their own component; vectors of different length
are not compared; rows that share an id are one vector, the smallest; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwindow.llm.links import components, roots
from arcwindow.plans.scratch import cut_lineage

COSINE = 0.93
#: Filters that a vector passes, on average.
LIST = 40
#: Filters that every vector passes at least.
LEAST = 40
#: Share of vectors that pass a filter, at most; caps are no narrower than ``MOST_ALPHA``.
MOST_SHARE = 1e-3
MOST_ALPHA = 0.75
#: Vectors of a block.
BLOCK = 512


class Code:
    """The product code for vectors of one length."""

    def __init__(self, dimension: int, share: float, seed: int = 5) -> None:
        random = np.random.default_rng([seed, dimension])
        self.rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        self.words = math.ceil(math.sqrt(LIST / share))
        self.cut = max(dimension // 2, 1)
        self.halves = [self._unit(random.standard_normal((self.words, n))) for n in (self.cut, max(dimension - self.cut, 1))]
        low, high = 0.0, 8.0  # the normal quantile of the share, by halving
        while high - low > 1e-6:
            middle = (low + high) / 2
            low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) / 2 > share else (low, middle)
        self.alpha = min(low / math.sqrt(dimension), MOST_ALPHA)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each unit vector."""
        turned = vectors @ self.rotation
        left = turned[:, : self.cut] @ self.halves[0].T
        right = turned[:, self.cut :] @ self.halves[1].T if vectors.shape[1] > 1 else np.zeros((len(vectors), self.words))
        order = np.argsort(right, axis=1)
        right = np.take_along_axis(right, order, axis=1)
        # a vector that passes few filters takes its LEAST best ones; they are among the best of each half
        k = min(LEAST, self.words)
        best = (-np.sort(-left, axis=1)[:, :k, None] + right[:, None, -k:]).reshape(len(left), -1)
        own = np.partition(best, best.shape[1] - k, axis=1)[:, -k]
        out = []
        for a, b, place, least in zip(left, right, order, np.minimum(own, self.alpha * math.sqrt(2)).tolist()):
            first = np.flatnonzero(a >= least - b[-1])
            begin = np.searchsorted(b, least - a[first])
            count = self.words - begin
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            out.append(np.sort(np.repeat(first, count) * self.words + place[at]))
        return out


VECTOR = "id {id}, label {label}, unit array<double>, copies bigint, filters array<bigint>"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``id, label, embedding, copies`` of one vector for each label and content."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = e.isNotNull() & (F.size(e) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
    return rows.select("vec_id", "label", e.cast("array<double>").alias("embedding"))


def decoded(vectors: DataFrame, share: float) -> DataFrame:
    """``id, label, unit, copies, filters``."""
    kinds = dict(vectors.dtypes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                lengths = np.array([len(v) for v in part["embedding"]])
                for dimension in np.unique(lengths).tolist():
                    rows = part.take(pa.array(np.flatnonzero(lengths == dimension)))
                    x = np.array(rows["embedding"].to_pylist(), dtype=np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay in range
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if dimension not in codes:
                        codes[dimension] = Code(dimension, share)
                    filters = codes[dimension].decode(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows["id"],
                            rows["label"],
                            pa.array(list(x), pa.list_(pa.float64())),
                            rows["copies"],
                            pa.array(filters, pa.list_(pa.int64())),
                        ],
                        names=["id", "label", "unit", "copies", "filters"],
                    )

    return vectors.mapInArrow(decode, VECTOR.format(id=kinds["id"], label=kinds["label"]))


class Bucket:
    """Vectors that share a filter; ``side`` says for a pair of blocks which of the two they are from."""

    def __init__(self, rows: list[dict]) -> None:
        self.ids = [r["id"] for r in rows]
        self.unit = np.array([r["unit"] for r in rows])
        self.copies = np.array([r["copies"] for r in rows])
        self.filters = [r["filters"] for r in rows]
        self.block = np.array([r["block"] for r in rows])
        self.filter, self.own = rows[0]["filter"], rows[0]["i"] == rows[0]["j"]

    def links(self, cosine: float) -> Iterator[tuple[object, int, object]]:
        """``id, links counted here, id it is connected with here``."""
        linked = self.unit @ self.unit.T >= cosine
        np.fill_diagonal(linked, False)
        if not self.own:  # pairs within a block are compared where the block meets itself
            linked &= self.block[:, None] != self.block[None, :]
        if linked.any():
            at = np.flatnonzero(linked.any(axis=1))
            linked = linked[np.ix_(at, at)]
            n = (linked & ~self.met_before(at)) @ self.copies[at]
            for i, count, root in zip(at.tolist(), n.tolist(), at[roots(linked)].tolist()):
                yield self.ids[i], count, self.ids[root]

    def met_before(self, at: np.ndarray) -> np.ndarray:
        """Pairs that share a smaller filter."""
        held = [f[: np.searchsorted(f, self.filter)] for f in (self.filters[i] for i in at)]
        row = np.repeat(np.arange(len(at)), [len(f) for f in held])
        name, place, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        inside = shared[place]
        has = np.zeros((len(at), int(shared.sum())), dtype=np.float32)
        has[row[inside], column[place[inside]]] = 1
        return has @ has.T > 0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row per row of ``vectors``."""
    rows = unit_vectors(vectors)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    equal = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    equal = cut_lineage(equal)
    copies = rows.join(equal, ["label", "embedding"]).select("vec_id", "id", "copies")
    copies = cut_lineage(copies)
    largest = equal.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    held = cut_lineage(decoded(equal.select("id", "label", "embedding", "copies"), min(MOST_SHARE, 1 / largest)))

    # buckets with company, cut into blocks; a row for each pair of blocks that a vector is in
    bucket = ["label", "filter", "dimension"]
    passed = held.select("id", "label", F.size("unit").alias("dimension"), F.explode("filters").alias("filter"))
    company = passed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = (
        passed.join(company, bucket)
        .select("id", *bucket, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("id", *bucket, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    units = placed.join(held.select("id", "unit", "copies", "filters"), "id")
    keys = [*bucket, "i", "j"]
    units = units.repartition(*keys).sortWithinPartitions(*keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[list[dict]]:
            key, group = None, []
            for batch in batches:
                for first in range(0, len(batch), 2048):
                    part = batch.slice(first, 2048)
                    columns = {c: part[c].to_pylist() for c in part.schema.names if c not in ("unit", "filters")}
                    wide = {}
                    for c in ("unit", "filters"):
                        flat, at = part[c].flatten().to_numpy(zero_copy_only=False), part[c].offsets.to_numpy()
                        at = at - at[0]
                        wide[c] = [flat[s:e] for s, e in zip(at[:-1], at[1:])]
                    for r in range(len(part)):
                        row = {c: v[r] for c, v in columns.items()} | {c: v[r] for c, v in wide.items()}
                        new = tuple(row[k] for k in keys)
                        if new != key and group:
                            yield group
                            group = []
                        key = new
                        group.append(row)
            if group:
                yield group

        found = (x for group in grouped() if len(group) > 1 for x in Bucket(group).links(cosine))
        while out := [x for _, x in zip(range(20_000), found)]:
            a, n, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(n, pa.int64()), pa.array(b, id_type)], names=["id", "n", "root"])

    kind = dict(held.dtypes)["id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    found = cut_lineage(units.select("id", *keys, "block", "unit", "copies", "filters").mapInArrow(count, f"id {kind}, n bigint, root {kind}"))
    n_links = found.groupBy("id").agg(F.sum("n").alias("n"))
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    connected = components(links)
    per_vector = (
        copies.join(n_links, "id", "left")
        .join(connected, "id", "left")
        .select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            # the id of equal vectors is their smallest, and so is that of components
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    result = vectors.select("vec_id").join(per_vector, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
