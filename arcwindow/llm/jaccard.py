"""Jaccard join of documents on word n-grams: a grouped prefix join.

A document's set holds the hashes of its distinct shingles. Two sets of similarity ``PERCENT`` or more
share a shingle of their prefixes, the first ``n - ceil(n * PERCENT%) + 1`` shingles in an order
that holds for all documents. The order here is: shingles with a low hash, those in few documents first and
the others by how many have them, in powers of two; then those with a high hash. So shingles of common
passages come into prefixes last, and only ``LOW_SHARE`` of all shingles are counted. A second
shingle is shuffled only if a bitmap of bounded size says that others have it too. Any such order gives the
same links. Of the smaller set of a pair a shorter prefix will do, as its overlap is a larger part of
it; these shingles are its early ones, and a pair needs one that is early in its smaller set.

Documents with the same size and prefix form a group. Groups meet in buckets, one for each shingle
of their prefixes and each of two size classes, so that a bucket holds sizes of one order.

* In buckets of up to ``SMALL`` groups, members are first compared with the bucket's leader, the smallest id.
  Jaccard distance is a metric: two members near the leader need no comparison, as both are linked
  with it, and neither do two whose distances to the leader differ by more than a link spans. What
  is left open, and is not connected by the links found so far, is compared pair by pair.
* Documents of larger groups, and of buckets that are larger or hold such a group, are joined anew among themselves, with all their shingles counted, not only
  low ones. Shingles that many of them have then come into a prefix only where nearly all of a document is
  common, so what still meets in a large bucket mostly is alike. It is compared in rounds: in each bucket up to ``LEADERS`` members
  outside its first component lead, and all members of other components are compared with them. Buckets share out their leaders
  by the members whose largest bucket they are, so a round makes at most ``LEADERS`` pairs a member, and the links of a round close most pairs before they are compared, also in small buckets. What ``ROUNDS`` rounds
  leave open is compared pair by pair in small buckets, and in larger ones within blocks, as matrices, of which
  a task puts out a tree of links, never pairs.

Pairs are compared by bitmaps of their sets first, which bound the overlap from above, and only if
that does not rule a link out, on the whole texts.

Hashes have 64 bits. Defined results: null texts, empty texts and texts without words have an empty
set and no links; documents with fewer words than a shingle have one shingle of all their words;
rows without id are left with no component; of rows that share an id the smallest text counts;
columns other than ``doc_id, text`` are ignored. Ids are of any type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from arcwindow.llm.links import components, one_text_per_id, packed, roots, small_batches
from arcwindow.llm.textbytes import LOWER, NOT_SPACE, Powers, pieces, runs, windows
from arcwindow.plans.scratch import cut_lineage

SHINGLE = 4
PERCENT = 85
#: Share of the range of hashes whose shingles are counted.
LOW_SHARE = 0.25
#: Powers of two in the number of documents beyond which shingles are ordered by it.
RARE = 3
#: Groups of a bucket whose open members are compared pair by pair.
SMALL = 48
#: Rounds in buckets that stay large, and leaders of a round.
ROUNDS = 3
LEADERS = 16
#: Bits of the bitmaps that hold shared shingles, and ids of texts to compare.
BITMAP_BITS = 26
#: Members of a block, and shingles that are compared at once.
BLOCK = 768
COLUMNS = 4096


class Shingles:
    """Sets of all texts of a batch."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.powers = Powers()

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted hashes of each text's distinct shingles."""
        for first, last, data, bounds in pieces(texts):
            lowered = LOWER[data]
            starts, ends, rows = runs(NOT_SPACE[lowered], bounds)
            words = self.powers.spans(self.powers.sums(lowered), starts, ends)
            counts = np.bincount(rows, minlength=last - first)
            hashes, owner = [], []
            for width in range(1, self.width + 1):
                h = windows(words, width)
                inside = rows[: len(h)] == rows[width - 1 :][: len(h)]
                if width < self.width:  # too few words for a shingle: all of them are one
                    inside &= counts[rows[: len(h)]] == width
                hashes.append(h[inside])
                owner.append(rows[: len(h)][inside])
            h, row = np.concatenate(hashes), np.concatenate(owner)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            for i in range(last - first):
                yield h[cuts[i] : cuts[i + 1]]


def prefix_length(n: np.ndarray | int, percent: int):
    """Shingles of which a partner must have one: ``n`` less the least overlap, plus one."""
    return n - -(-n * percent // 100) + 1


def early_length(n: np.ndarray | int, percent: int):
    """Shingles of which a partner that is no smaller must have one."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def bitmap(h: np.ndarray) -> bytes:
    """One bit for each hash, in about as many bits as there are hashes."""
    size = max(64, 1 << max(len(h) - 1, 0).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[h & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """An upper bound of the overlap of two sets: every bit that differs is a hash of one of them only."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    small, large = sorted((8 * len(a), 8 * len(b)))
    if len(a) < len(b):
        x, y = y, x
    while large > small:  # x has more bits: the halves fall together
        large //= 2
        x = (x & ((1 << large) - 1)) | (x >> large)
    return min(n_a, n_b, (n_a + n_b - (x ^ y).bit_count()) // 2)


class Bitmap:
    """A set of 64-bit numbers, of bounded size: those in it are found, of others a few."""

    def __init__(self, numbers: DataFrame, bits: int | None = None) -> None:
        self.mask = (1 << (bits or BITMAP_BITS)) - 1
        at = F.col(numbers.columns[0]).bitwiseAND(F.lit(self.mask))
        words = numbers.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        self.words = np.zeros(self.mask // 64 + 1, dtype=np.int64)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy()

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.int64, copy=False) & self.mask
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1


LOW_SETS = "n bigint, n_low bigint, k1 bigint, k2 bigint, bits binary, low array<bigint>, place array<int>"


def low_sets(texts: DataFrame, width: int, percent: int, share: float, shared: Bitmap | None = None) -> DataFrame:
    """``doc_id, n, n_low, k1, k2, bits, low, place``: size, keys and bitmap of the whole set, its lowest shingles by hash.

    ``share`` is that of the low ones. With ``shared``, only those in it are listed. ``place`` is theirs in the whole set.
    Texts may be packed.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(width), zstandard.ZstdDecompressor()
        for batch in batches:
            if "z" in batch.schema.names:
                texts_ = pa.array([open_.decompress(z.as_py()) for z in batch["z"]], pa.binary())
            else:
                texts_ = batch["text"]
            n, n_low, k1, k2, bits, low, place = [], [], [], [], [], [], []
            for h in shingles(texts_):
                n.append(len(h))
                n_low.append(len(h) if share == 1 else int(np.searchsorted(h, limit)))
                k1.append(np.add.reduce(h))
                k2.append(np.add.reduce(h * h * np.uint64(0x2545F4914F6CDD1D) ^ (h >> np.uint64(17))))
                bits.append(bitmap(h))
                first = h[: max(n_low[-1], prefix_length(len(h), percent) if len(h) else 0)]
                places = np.arange(len(first)) if shared is None else np.flatnonzero(shared(first))
                low.append(first[places])
                place.append(places)
            at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in low]))), pa.int32())
            flat = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
            places = np.concatenate(place) if place else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(n_low, pa.int64()),
                    *[pa.array(np.array(k, dtype=np.uint64).view(np.int64)) for k in (k1, k2)],
                    pa.array(bits, pa.binary()),
                    pa.ListArray.from_arrays(at, pa.array(flat)),
                    pa.ListArray.from_arrays(at, pa.array(places, pa.int32())),
                ],
                names=["doc_id", "n", "n_low", "k1", "k2", "bits", "low", "place"],
            )

    return texts.mapInArrow(sets, f"doc_id {dict(texts.dtypes)['doc_id']}, {LOW_SETS}")


def prefixes(texts: DataFrame, sizes: DataFrame, width: int, percent: int, share: float) -> DataFrame:
    """``doc_id, n, k1, k2, shared, early, alone``: the prefix's shingles that others have too, those of them that
    are early, and whether the prefix has others."""
    counted = low_sets(texts, width, percent, share).select(F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # how often, in powers of two; 0 for rare ones
    often = F.greatest(F.length(F.bin("n")) - RARE - 1, F.lit(0))
    known = cut_lineage(counted.where("n > 1").select("token", often.cast("int").alias("often")))
    low = low_sets(texts, width, percent, share, Bitmap(known.select("token")))
    rows = low.select("doc_id", F.explode(F.arrays_zip("low", "place")).alias("s")).select(
        "doc_id", F.col("s.place").alias("r"), F.col("s.low").alias("token")
    )
    held = rows.join(known, "token").groupBy("doc_id").agg(F.collect_list(F.struct("r", "token", "often")).alias("t"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_low = (batch[c].to_numpy(zero_copy_only=False) for c in ("n", "n_low"))
            flat, at = batch["t"].flatten(), batch["t"].offsets.to_numpy()
            at = at - at[0]
            r, token, often = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            doc = np.repeat(np.arange(len(batch)), np.diff(at))
            low = r < n_low[doc]
            often = np.where(low, often, 0)
            # places in the order: low and rare ones by hash, then the other low ones by how often, then the rest
            order = np.lexsort((r, doc))
            r, token, often, low = r[order].astype(np.int64), token[order], often[order], low[order]
            late = often > 0
            before = np.concatenate(([0], np.cumsum(late)))
            late_before = before[:-1] - before[at[doc]]
            rank = np.where(low, r - late_before, r)
            by_often = np.lexsort((r, often, ~late, doc))  # late ones first in each document, in their order
            nth = np.arange(len(doc)) - at[doc]
            early = n_low - (before[at[1:]] - before[at[:-1]])
            is_late = late[by_often]
            rank[by_often[is_late]] = early[doc[is_late]] + nth[is_late]
            p = prefix_length(n, percent)
            shared = rank < p[doc]
            early_ones = rank < early_length(n, percent)[doc]
            lists, counts = [], {}
            for name, chosen in (("shared", shared), ("early", early_ones)):
                counts[name] = np.bincount(doc[chosen], minlength=len(batch))
                cuts = pa.array(np.concatenate(([0], np.cumsum(counts[name]))), pa.int32())
                lists.append(pa.ListArray.from_arrays(cuts, pa.array(token[chosen])))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("doc_id", "n", "k1", "k2")], *lists, pa.array(counts["shared"] < p)],
                names=["doc_id", "n", "k1", "k2", "shared", "early", "alone"],
            ).filter(pa.array(counts["shared"] > 0))

    kind = dict(texts.dtypes)["doc_id"]
    return held.join(sizes, "doc_id").select("doc_id", "n", "n_low", "k1", "k2", "t").mapInArrow(
        place, f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, shared array<bigint>, early array<bigint>, alone boolean"
    )


def packed_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, z`` of the texts with these ids, written; others are left out before they are packed."""
    ids = cut_lineage(ids.distinct())
    asked = Bitmap(ids.select(F.xxhash64("doc_id").alias("h")))
    return cut_lineage(packed(texts, asked=asked).join(ids, "doc_id", "left_semi"))


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs compared on whole texts; only texts that are part of a pair are shuffled with them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    return compared(pairs.select("a", "b"), packed_of(texts, ids), width)


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``a, b, n_a, n_b, n_both``: sizes and overlap of the whole sets of each pair."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(width), zstandard.ZstdDecompressor()
        last_b, set_b = None, None
        for batch in batches:
            b_ids = batch["b"].to_pylist()
            sizes = []
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                a_sets = shingles(pa.array([open_.decompress(z.as_py()) for z in part["za"]], pa.binary()))
                for i, set_a in enumerate(a_sets):
                    if b_ids[first + i] != last_b:  # pairs come sorted by b
                        last_b = b_ids[first + i]
                        set_b = next(shingles(pa.array([open_.decompress(part["zb"][i].as_py())], pa.binary())))
                    both = int(np.isin(set_a, set_b, assume_unique=True).sum()) if len(set_b) else 0
                    sizes.append((len(set_a), len(set_b), both))
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], *[pa.array(x, pa.int64()) for x in (zip(*sizes) if sizes else ([], [], []))]],
                names=["a", "b", "n_a", "n_b", "n_both"],
            )

    kind = dict(pairs.dtypes)["a"]
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb")
    return joined.mapInArrow(compare, f"a {kind}, b {kind}, n_a bigint, n_b bigint, n_both bigint")


def bounded(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b, most``: the sizes of each pair's sets and an upper bound of their overlap."""
    side = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")]
            most = pa.array([most_shared(*row) for row in zip(*columns)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("a", "b", "n_a", "n_b")], most], names=["a", "b", "n_a", "n_b", "most"]
            )

    kind = dict(pairs.dtypes)["a"]
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(
        bound, f"a {kind}, b {kind}, n_a bigint, n_b bigint, most bigint"
    )


class Block:
    """Members of a bucket, of one or two of its blocks, compared with one another."""

    def __init__(self, rows: list[dict], sets: list[np.ndarray]) -> None:
        self.ids = [r["x"] for r in rows]
        column = lambda name: np.array([r[name] for r in rows])
        self.n, self.early = column("n"), column("early")
        self.component = column("component")
        self.block, self.own = column("block"), rows[0]["i"] == rows[0]["j"]
        self.sets = sets

    def open(self, percent: int) -> np.ndarray:
        """Pairs that are not connected and that nothing rules out yet."""
        n = self.n
        smaller = n[:, None] <= n[None, :]
        fits = smaller & (n[:, None] * 100 >= n[None, :] * percent) & self.early[:, None]
        fits |= fits.T
        fits &= self.component[:, None] != self.component[None, :]
        return fits if self.own else fits & (self.block[:, None] != self.block[None, :])

    def links(self, percent: int) -> Iterator[tuple]:
        """A tree of the links among open pairs."""
        open_ = self.open(percent)
        at = np.flatnonzero(open_.any(axis=1))
        if not len(at):
            return
        sets = [self.sets[i] for i in at]
        names, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(at)), [len(s) for s in sets])
        shared = count > 1
        column, inside = np.cumsum(shared) - 1, shared[place]
        both = np.zeros((len(at), len(at)), dtype=np.float32)
        rows, columns = row[inside], column[place[inside]]
        for first in range(0, int(shared.sum()), COLUMNS):  # so many shingles at a time
            part = (columns >= first) & (columns < first + COLUMNS)
            has = np.zeros((len(at), COLUMNS), dtype=np.float32)
            has[rows[part], columns[part] - first] = 1
            both += has @ has.T
        n = np.array([len(s) for s in sets], dtype=np.float64)
        linked_ = open_[np.ix_(at, at)] & (both * 100.0 >= (n[:, None] + n[None, :] - both) * percent)
        for i, root in enumerate(roots(linked_).tolist()):
            if root != i:
                yield self.ids[at[i]], self.ids[at[root]]


def block_links(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the members of each bucket; ``rows`` has its members and their number ``m``."""
    kind = dict(rows.dtypes)["x"]
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = rows.withColumns(
        {"block": F.pmod(F.xxhash64("x"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))}
    ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    z = packed_of(texts, rows.select(F.col("x").alias("doc_id"))).withColumnRenamed("doc_id", "x")
    columns = ["bucket", "i", "j", "x", "n", "early", "component", "block"]
    units = placed.select(*columns).join(z, "x").select(*columns, "z")
    units = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(width), zstandard.ZstdDecompressor()
        kinds: list[pa.DataType] = []

        def grouped() -> Iterator[Block]:
            key, group, sets = None, [], []
            for batch in batches:
                kinds[:] = [batch.schema.field("x").type]
                for first in range(0, len(batch), 512):
                    part = batch.slice(first, 512)
                    own = shingles(pa.array([open_.decompress(z.as_py()) for z in part["z"]], pa.binary()))
                    for row, set_ in zip(part.drop_columns(["z"]).to_pylist(), own):
                        new = (row["bucket"], row["i"], row["j"])
                        if new != key and group:
                            yield Block(group, sets)
                            group, sets = [], []
                        key = new
                        group.append(row)
                        sets.append(set_)
            if group:
                yield Block(group, sets)

        found = (link for block in grouped() for link in block.links(percent))
        while out := [x for _, x in zip(range(20_000), found)]:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, kinds[0]), pa.array(b, kinds[0])], names=["a", "b"])

    return units.mapInArrow(compare, f"a {kind}, b {kind}")


def linked(percent: int, both: str = "n_both"):
    return F.col(both) * 100 >= (F.col("n_a") + F.col("n_b") - F.col(both)) * percent


def distance(both: str):
    return 1 - F.col(both) / (F.col("n_a") + F.col("n_b") - F.col(both))


def size_class(n: str, percent: int):
    """Sizes that can be linked are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-math.log(percent / 100)) + 1e-9)


def groups_of(found: DataFrame) -> DataFrame:
    """``doc_id, n, gid, shared, early``: documents of the same size and prefix have the smallest id's group."""
    key = F.when(F.col("alone"), F.struct(F.xxhash64("doc_id"), F.lit(-1))).otherwise(F.struct(F.xxhash64("n", "shared"), F.size("shared")))
    keyed = found.select("doc_id", "n", "shared", "early", key.alias("key"))
    group = keyed.groupBy("key").agg(F.min("doc_id").alias("gid"))
    return cut_lineage(keyed.join(group, "key").select("doc_id", "n", "gid", "shared", "early"))


def buckets_of(members: DataFrame, percent: int) -> DataFrame:
    """``bucket, gid, early, leader, m``: groups by shingle and size class, the first early one, and how many."""
    c = size_class("n", percent)
    marked = F.transform("shared", lambda t: F.struct(t.alias("token"), F.array_contains("early", t).alias("early")))
    rows = members.where("doc_id = gid").select("gid", F.explode(F.array(c, c + 1)).alias("size_class"), marked.alias("s"))
    rows = rows.select("gid", "size_class", F.explode("s").alias("s")).select(
        F.xxhash64(F.lit("t"), "s.token", "size_class").alias("bucket"), "gid", "s.early"
    )
    kept = rows.groupBy("bucket").agg(F.min(F.when(F.col("early"), F.col("gid"))).alias("leader"), F.count(F.lit(1)).alias("m"))
    return cut_lineage(rows.join(kept.where("m > 1 AND leader IS NOT NULL"), "bucket").select("bucket", "gid", "early", "leader", "m"))


def in_buckets(buckets: DataFrame, members: DataFrame) -> DataFrame:
    """``bucket, x, n, early, leader``: members of the groups in each bucket, and of each group as a bucket of its own."""
    own = members.select(
        F.xxhash64(F.lit("g"), "gid").alias("bucket"), F.col("doc_id").alias("x"), "n", F.lit(True).alias("early"), F.col("gid").alias("leader")
    )
    of_group = members.select("gid", F.col("doc_id").alias("x"), "n")
    return buckets.join(of_group, "gid").select("bucket", "x", "n", "early", "leader").unionByName(own)


def open_buckets(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with ``component, first, m``; of equal buckets only one."""
    so_far = components(links).select(F.col("id").alias("x"), "component")
    now = rows.join(so_far, "x", "left").withColumn("component", F.coalesce("component", "x"))
    member = F.xxhash64("x", "early")
    several = now.groupBy("bucket").agg(
        F.min("component").alias("first"),
        F.max("component").alias("last"),
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(member).alias("h1"),
        F.bit_xor(F.xxhash64(member)).alias("h2"),
    )
    several = several.where("first <> last").groupBy("m", "h1", "h2").agg(F.min(F.struct("bucket", "first")).alias("b"))
    return cut_lineage(now.join(several.select("b.bucket", "b.first", "m"), "bucket"))


def fitting(x: str, y: str, percent: int):
    """Whether sizes can be linked, and the shingle is early in the smaller set."""
    early = (F.col(f"{x}early") & (F.col(f"{x}n") <= F.col(f"{y}n"))) | (F.col(f"{y}early") & (F.col(f"{y}n") <= F.col(f"{x}n")))
    return early & (F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent)


def linked_pairs(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that are linked: by bitmaps, then on whole texts."""
    open_ = cut_lineage(bounded(pairs, sizes).where(linked(percent, "most")))
    return cut_lineage(verified(open_, texts, width).where(linked(percent)).select("a", "b"))


def pairs_of(rows: DataFrame, percent: int, *conditions) -> DataFrame:
    """Pairs of members of the same bucket and different components."""
    x, y = rows.alias("x"), rows.alias("y")
    fits = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.x") > F.col("y.x"))
    for condition in (fitting("x.", "y.", percent), *conditions):
        fits = fits & condition
    return x.join(y, fits).select(F.col("x.x").alias("a"), F.col("y.x").alias("b")).distinct()


def small_bucket_links(rows: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the members of small buckets ``bucket, x, n, early, leader``."""
    rows = cut_lineage(rows.where("x <> leader"))
    star = rows.select(F.col("x").alias("a"), F.col("leader").alias("b")).distinct()
    star = cut_lineage(bounded(star, sizes))
    near = cut_lineage(verified(star.where(linked(percent, "most")), texts, width))
    links = near.where(linked(percent)).select("a", "b")

    # what the leaders leave open: distances to the leader are known, or at least bounded from below
    ruled_out = star.where(~linked(percent, "most")).select("a", "b", distance("most").alias("d_low"), F.lit(1.0).alias("d_high"))
    compared_ = near.select("a", "b", distance("n_both").alias("d_low"), distance("n_both").alias("d_high"))
    to_leader = ruled_out.unionByName(compared_).withColumnsRenamed({"a": "x", "b": "leader"})
    placed = rows.join(to_leader, ["x", "leader"]).drop("leader")
    # buckets whose members are all near their leader leave nothing open
    span = (100 - percent) / 100 + 1e-9
    far_buckets = placed.groupBy("bucket").agg(F.max("d_low").alias("d")).where(f"d > {span}").select("bucket")
    now = open_buckets(cut_lineage(placed.join(far_buckets, "bucket", "left_semi")), links)
    apart = F.greatest("x.d_low", "y.d_low") > span
    alike = (F.col("x.d_low") - F.col("y.d_high") <= span) & (F.col("y.d_low") - F.col("x.d_high") <= span)
    return links.unionByName(linked_pairs(pairs_of(now, percent, apart, alike), sizes, texts, width, percent))


def large_bucket_links(rows: DataFrame, links: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the members of buckets ``bucket, x, n, early``, beyond the links there are."""
    found = links.limit(0)
    live = rows.drop("leader")
    for _ in range(ROUNDS):
        now = open_buckets(live, links.unionByName(found))
        if not now.head(1):
            return found
        crowded = now.where(F.col("m") > SMALL)
        if not crowded.head(1):
            break
        # members count in their largest bucket only, so buckets of nearly the same members do not all have their leaders
        home = crowded.groupBy("x").agg(F.max(F.struct("m", "bucket")).alias("h")).select("x", "h.bucket")
        at_home = crowded.join(home, ["x", "bucket"], "left_semi")
        in_order = Window.partitionBy("bucket").orderBy("x")
        outside = at_home.where(F.col("component") != F.col("first")).withColumn("nth", F.row_number().over(in_order))
        share = at_home.groupBy("bucket").agg(F.count(F.lit(1)).alias("at_home"))
        own = ["x", "n", "early", "component"]
        ahead = outside.where(F.col("nth") <= LEADERS).join(share, "bucket").where(F.col("nth") * F.col("m") <= F.col("at_home") * LEADERS)
        leaders = cut_lineage(ahead.select("bucket", *[F.col(c).alias(f"l_{c}") for c in own]))
        others = crowded.join(leaders, "bucket").where(F.col("component") != F.col("l_component")).where(fitting("", "l_", percent))
        pairs = others.select(F.greatest("x", "l_x").alias("a"), F.least("x", "l_x").alias("b")).distinct()
        found = found.unionByName(linked_pairs(pairs, sizes, texts, width, percent))
        # all about the leaders is known
        done = leaders.select("bucket", F.col("l_x").alias("x"))
        live = now.select("bucket", "x", "n", "early").join(done, ["bucket", "x"], "left_anti")
    now = open_buckets(live, links.unionByName(found))
    in_pairs = linked_pairs(pairs_of(now.where(F.col("m") <= SMALL), percent), sizes, texts, width, percent)
    in_blocks = cut_lineage(block_links(now.where(F.col("m") > SMALL), texts, width, percent))
    return found.unionByName(in_pairs).unionByName(in_blocks)


def join_components(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per row of the documents."""
    small_batches(documents)
    texts, _ = one_text_per_id(documents)
    sizes = cut_lineage(low_sets(texts, width, percent, LOW_SHARE).drop("low", "place"))
    found = cut_lineage(prefixes(texts, sizes.drop("bits"), width, percent, LOW_SHARE))

    # equal sets are linked, and one of them goes on
    same = found.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    with_rep = found.join(same, ["n", "k1", "k2"])
    copies = cut_lineage(with_rep.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    members = groups_of(with_rep.where("doc_id = rep"))
    buckets = buckets_of(members, percent)

    # large groups, and all groups that meet them or many others in a bucket, are joined anew
    large_group = cut_lineage(members.groupBy("gid").count().where(F.col("count") > SMALL).select("gid"))
    large_bucket = buckets.where(F.col("m") > SMALL).unionByName(buckets.join(large_group, "gid", "left_semi")).select("bucket").distinct()
    large_bucket = cut_lineage(large_bucket)
    crowded = buckets.join(large_bucket, "bucket", "left_semi").select("gid").unionByName(large_group).distinct()
    again = cut_lineage(members.join(crowded, "gid", "left_semi").select("doc_id"))
    small = members.join(large_group, "gid", "left_anti")
    rows = in_buckets(buckets.join(large_bucket, "bucket", "left_anti"), small)
    links = small_bucket_links(rows, sizes, texts, width, percent)

    if again.head(1):
        z = packed_of(texts, again)
        all_sizes = sizes.join(again, "doc_id", "left_semi").withColumn("n_low", F.col("n")).drop("bits")
        members = groups_of(cut_lineage(prefixes(z, all_sizes, width, percent, 1)))
        rows = cut_lineage(in_buckets(buckets_of(members, percent), members))
        links = links.unionByName(large_bucket_links(rows, links, sizes, texts, width, percent))
    labels = components(links.unionByName(copies))
    labels = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    everything = documents.select("doc_id").join(sizes.select("doc_id", "n"), "doc_id", "left").join(labels, "doc_id", "left")
    return everything.select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those linked, over links, with one that comes before; all columns.

    Of linked documents the smallest id stays. Where ids are repeated or missing, every row is compared as a
    document of its own, rows without id come last, and of equal ids one row stays.
    """
    _, unique = one_text_per_id(documents)
    if unique and not documents.where("doc_id IS NULL").head(1):
        found = join_components(documents, width, percent)
        gone = cut_lineage(found.where("component_id <> doc_id").select("doc_id").distinct())
        return documents.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
    rows = cut_lineage(documents.select(F.struct(*[f"`{c}`" for c in documents.columns]).alias("row")).withColumn("key", F.monotonically_increasing_id()))
    found = join_components(rows.select(F.col("key").alias("doc_id"), "row.text"), width, percent)
    placed = found.join(rows.select(F.col("key").alias("doc_id"), F.col("row.doc_id").alias("id")), "doc_id")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("f"))
    kept = cut_lineage(first.select(F.col("f.doc_id").alias("key")))
    return rows.join(kept, "key", "left_semi").select("row.*")
