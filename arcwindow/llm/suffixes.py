"""Exact substring dedup by a distributed merge sort of front-coded suffix runs.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier. All starts are
covered, but not every suffix is sorted. Every string of ``length`` bytes has an anchor, the place of
its least hash of ``ANCHOR`` bytes, which depends on the string alone; strings that follow one another
mostly share their anchor. So only suffixes at anchors are sorted, each together with the bytes
on its left that the strings around it need. A segment is such a suffix with all strings that have
its anchor.

1. Anchors are counted. A string whose anchor occurs once in the corpus is new, and goes no further.
2. Documents that share an anchor are brought together, as far as one choice for each allows. Tasks
   sort the segments of their anchors and front-code them: of equal ones only the earliest is
   kept, the others are settled. Runs are cut by ranges of the key.
3. Tasks merge the runs of a range with a loser tree that holds, for every run, the length of the
   prefix it shares with the last winner. Where these differ they decide; where they are the same,
   comparing goes on behind them, so no known prefix is compared again. The order, and the lengths
   of prefixes shared by neighbours, say which strings are equal, and which of them comes first.
4. What is settled becomes removed ranges of documents.

An anchor that more than ``MANY`` segments share, such as a common line in changing company, is split:
its strings become segments of their own, spread by their whole content.

Defined results: a null text is an empty one; texts shorter than ``length`` lose nothing; a row without
id has no place in the order, is never earlier and loses nothing; of rows that share an id the smallest
text counts, and the others lose nothing; columns other than ``doc_id, text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from arcwindow.llm.links import one_text_per_id, packed, small_batches
from arcwindow.llm.textbytes import Powers, mixed, pieces
from arcwindow.plans.scratch import cut_lineage

LENGTH = 100
ANCHOR = 40
#: Segments of an anchor beyond which its strings are sorted one by one.
MANY = 5000
#: Documents that are brought together for an anchor they share, about.
TOGETHER = 200
#: Segments that a task sorts together, about.
RUN = 40_000
#: Different anchors of a range of keys, which one merge handles.
RANGE = 20_000
PLACE_BITS = 22


class Anchors:
    """Finds the anchors of all strings of ``length`` bytes."""

    def __init__(self, length: int, anchor: int) -> None:
        self.length, self.anchor = length, anchor
        self.powers = Powers()

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """``rows, hashes, anchors, first starts, last starts`` of the segments; places count from the first text."""
        n, width = len(data) - self.anchor + 1, self.length - self.anchor + 1
        count = n - width + 1
        if count <= 0:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        total = self.powers.sums(data)
        h = (total[self.anchor :] - total[:n]) * self.powers.down[:n]
        if n >> PLACE_BITS:  # a very long text: blocks of places, each with its own numbering
            anchor = np.concatenate(
                [
                    self._least(h[i : i + (1 << PLACE_BITS) - 1], width) + i
                    for i in range(0, count, (1 << PLACE_BITS) - width)
                ]
            )[:count]
        else:
            anchor = self._least(h, width)
        ends = np.repeat(bounds[1:], np.diff(bounds))[:count]
        at = np.flatnonzero(np.arange(count) + self.length <= ends)
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        anchor = anchor[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        rows = np.searchsorted(bounds, at[first], side="right") - 1
        return rows, mixed(h[anchor[first]]), anchor[first], at[first], at[last]

    @staticmethod
    def _least(h: np.ndarray, width: int) -> np.ndarray:
        """The place of the least value, the first of equals, of every ``width`` values."""
        n = len(h)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        keyed = np.full(n + -n % width, ~np.uint64(0))
        keyed[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
        table = keyed.reshape(-1, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - width + 1
        return (np.minimum(behind[:count], ahead[width - 1 :][:count]) & mask).astype(np.int64)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Run:
    """A sorted run of front-coded keys: each has the length it shares with the one before, and the rest."""

    def __init__(self, keys: list[bytes], shared: list[int]) -> None:
        self.keys, self.shared, self.at = keys, shared, 0


def merged(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs: for each key in order its run, its place in the run, and what it shares with the key before."""
    k = len(runs)
    if k == 1:
        n = len(runs[0].keys)
        return [0] * n, list(range(n)), runs[0].shared
    out_run, out_place, out_shared = [], [], []
    head: list[bytes | None] = [r.keys[0] if r.keys else None for r in runs]
    common = [0] * k  # what each run's head shares with the last winner
    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size

    def first_of(a: int, b: int) -> tuple[int, int]:
        """``winner, loser``; the loser then knows what it shares with the winner."""
        if b < 0 or b >= k or head[b] is None:
            return a, b
        if a < 0 or a >= k or head[a] is None:
            return b, a
        if common[a] != common[b]:  # the one that shares more with the last winner comes first
            return (a, b) if common[a] > common[b] else (b, a)
        x, y = head[a], head[b]
        n = shared_prefix(x, y, common[a])
        if x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a < b):
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    def play(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = first_of(play(2 * node), play(2 * node + 1))
        return winner

    winner = play(1)
    while 0 <= winner < k and head[winner] is not None:
        run = runs[winner]
        out_run.append(winner)
        out_place.append(run.at)
        out_shared.append(common[winner] if out_shared else 0)
        run.at += 1
        if run.at < len(run.keys):
            head[winner], common[winner] = run.keys[run.at], run.shared[run.at]
        else:
            head[winner] = None
        node = (winner + size) // 2
        while node:
            winner, losers[node] = first_of(winner, losers[node])
            node //= 2
    return out_run, out_place, out_shared


def pack_run(segments: list[tuple]) -> bytes:
    """Front-code sorted segments ``(key, left, anchor, first, last, ...)``."""
    keys = [s[0] for s in segments]
    shared = [0, *(shared_prefix(a, b, 0) for a, b in zip(keys, keys[1:]))]
    rests = [k[n:] for k, n in zip(keys, shared)]
    numbers = np.array([(n, len(r), len(s[1]), s[2], s[3], s[4]) for s, n, r in zip(segments, shared, rests)], dtype=np.int64)
    payload = numbers.T.tobytes() + b"".join(rests) + b"".join(s[1] for s in segments)
    return zstandard.ZstdCompressor(level=1).compress(payload)


def unpack_run(n: int, run: bytes) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """``keys, numbers, left bytes`` of a packed run."""
    payload = zstandard.ZstdDecompressor().decompress(run)
    numbers = np.frombuffer(payload, dtype=np.int64, count=6 * n).reshape(6, n)
    at = 48 * n
    keys, last = [], b""
    for share, rest in zip(numbers[0].tolist(), numbers[1].tolist()):
        last = last[:share] + payload[at : at + rest]
        keys.append(last)
        at += rest
    left = []
    for size in numbers[2].tolist():
        left.append(payload[at : at + size])
        at += size
    return keys, numbers, left


def settled(
    shared: np.ndarray, left: list[bytes], numbers: np.ndarray, order: np.ndarray, length: int, anchor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings also start earlier, of segments in sorted order.

    ``order`` ranks the segments by document and anchor. A string ``o`` bytes before its anchor is known
    by the first ``length - o`` bytes of its suffix and the ``o`` bytes on the left. Returns places of
    segments, and the least and largest ``o`` of their strings that start earlier elsewhere.
    """
    n, width = len(left), length - anchor + 1
    right = shared - 8  # a key begins with its hash
    lefts = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in left), dtype=np.uint8).reshape(n, width)
    left_order = lefts.view(f"S{width}").ravel().argsort(kind="stable")
    equal = lefts[left_order][1:] == lefts[left_order][:-1]
    left_shared = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    at, first, last = numbers
    least, most = np.full(n, length, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    left_class = np.zeros(n, dtype=np.int64)
    for o in range(width):
        here = np.flatnonzero((at - last <= o) & (o <= at - first))
        if len(here) < 2:
            continue
        right_class = np.cumsum(right < length - o)
        left_class[left_order[1:]] = np.cumsum(left_shared < o)
        both = right_class[here] * n + left_class[here]
        by = np.lexsort((order[here], both))
        same = both[by[1:]] == both[by[:-1]]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(by)), 0))
        found = here[by[order[here][by] > order[here][by[head]]]]
        least[found] = np.minimum(least[found], o)
        most[found] = o
    found = np.flatnonzero(most >= 0)
    return found, least[found], most[found]


def united(ranges: list[tuple]) -> list[tuple]:
    """``(document, start, end)`` with overlapping and touching ranges of a document made one."""
    out: list[tuple] = []
    for doc, start, end in sorted(ranges):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            if end > out[-1][2]:
                out[-1] = (doc, out[-1][1], end)
        else:
            out.append((doc, start, end))
    return out


def removed_ranges(texts: DataFrame, z: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, start, end``: byte ranges, overlapping ones too, that strings cover which also start earlier.

    ``z`` holds the texts once more, packed.
    """
    kind = dict(texts.dtypes)["doc_id"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, anchor)
        for batch in batches:
            for first, last, data, bounds in pieces(batch["text"]):
                rows, h, *_ = find(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(rows + first)), pa.array(h.astype(np.uint64).view(np.int64))], names=["doc_id", "h"]
                )

    anchors = texts.mapInArrow(hashes, f"doc_id {kind}, h bigint")
    known = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = cut_lineage(known)
    held = anchors.join(known, "h").groupBy("doc_id").agg(
        F.collect_set("h").alias("h"),
        F.collect_set(F.when(F.col("n") > MANY, F.col("h"))).alias("many"),
        F.min(F.struct("h", "n")).alias("_least"),
    )
    # documents meet by their least anchor; a common one is spread over some tasks
    spread = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_least.n") / TOGETHER))
    ranges = max(1, -(-known.count() // RANGE))
    suspects = z.join(held, "doc_id").withColumn("_at", F.xxhash64("_least.h", spread))
    suspects = suspects.repartition("_at").sortWithinPartitions("_at", "doc_id")  # the same runs in every attempt

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, unzip = Anchors(length, anchor), zstandard.ZstdDecompressor()
        segments: dict[tuple, tuple] = {}
        gone: list[tuple] = []
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            parts: dict[int, list] = {}
            for s in sorted(segments.values(), key=lambda s: (s[0], s[1])):
                parts.setdefault(int.from_bytes(s[0][:8], "big") * ranges >> 64, []).append(s)
            some: list[tuple] = []
            for part, of_part in parts.items():
                some.append((part, len(of_part), pack_run(of_part), [s[5] for s in of_part], None, None))
                if len(some) == 64:
                    yield run_rows(some, id_type)
                    some = []
            some += [(hash(doc) % ranges, None, None, [doc], start, end) for doc, start, end in united(gone)]
            if some:
                yield run_rows(some, id_type)
            segments.clear()
            gone.clear()

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                raw = pa.array([unzip.decompress(z.as_py()) for z in part["z"]], pa.binary())
                wanted, many, ids = part["h"].to_pylist(), part["many"].to_pylist(), part["doc_id"].to_pylist()
                for low, high, data, bounds in pieces(raw):
                    for name, new in segments_of(find, data, bounds, ids[low:high], wanted[low:high], many[low:high]):
                        old = segments.setdefault(name, new)
                        if old is not new:  # the earlier of two equal ones stays
                            if (new[5], new[2]) < (old[5], old[2]):
                                segments[name], new = new, old
                            gone.append((new[5], new[3], new[4] + length))
                if len(segments) >= RUN:
                    yield from flush()
        if segments:
            yield from flush()

    def segments_of(find, data, bounds, ids, wanted, many) -> Iterator[tuple[tuple, tuple]]:
        """The segments of anchors that are wanted: what makes them equal, and ``(key, left, anchor, first, last, id)``."""
        rows, h, at, first, last = find(data, bounds)
        h = h.view(np.int64)
        keep, split = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        cuts = np.searchsorted(rows, np.arange(len(ids) + 1))
        for row in range(len(ids)):
            part = slice(cuts[row], cuts[row + 1])
            if part.stop > part.start:
                keep[part] = np.isin(h[part], wanted[row])
                if many[row]:
                    split[part] = np.isin(h[part], many[row])
        text = data.tobytes()
        for i in np.flatnonzero(keep).tolist():
            base, doc = int(bounds[rows[i]]), ids[rows[i]]
            a, s, e = int(at[i]), int(first[i]), int(last[i])
            if split[i]:  # every string is a segment, known by its content
                for p in range(s, e + 1):
                    string = text[p : p + length]
                    key = hashlib.blake2b(string, digest_size=8).digest() + string
                    yield (key, b"", 0, 0), (key, b"", p - base, p - base, p - base, doc)
            else:
                key, left = (int(h[i]) % (1 << 64)).to_bytes(8, "big") + text[a : e + length], text[s:a][::-1]
                yield (key, left, a - s, a - e), (key, left, a - base, s - base, e - base, doc)

    run_kind = f"part bigint, n bigint, run binary, ids array<{kind}>, start bigint, end bigint"
    runs = suspects.select("doc_id", "z", "h", "many").mapInArrow(sort_runs, run_kind)

    def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def grouped() -> Iterator[list]:
            """The runs of a range of keys; ranges of documents that are settled already come first, as they are."""
            nonlocal id_type
            last, group = None, []
            for batch in batches:
                id_type = batch.schema.field("ids").type.value_type
                is_run = pc.is_valid(batch["n"])
                settled_ = batch.filter(pc.invert(is_run))
                if len(settled_):
                    yield [settled_["ids"].flatten(), settled_["start"], settled_["end"]]
                batch = batch.filter(is_run)
                for i in range(len(batch)):
                    part = batch["part"][i].as_py()
                    if part != last and group:
                        yield group
                        group = []
                    last = part
                    group.append((batch["n"][i].as_py(), batch["run"][i].as_py(), batch["ids"][i].values))
            if group:
                yield group

        for group in grouped():
            if isinstance(group[0], pa.Array):
                yield pa.RecordBatch.from_arrays(group, names=["doc_id", "start", "end"])
                continue
            unpacked = [unpack_run(n, run) for n, run, _ in group]
            run, place, shared = merged([Run(keys, numbers[0].tolist()) for keys, numbers, _ in unpacked])
            run, place = np.array(run), np.array(place)
            start_of = np.cumsum([0, *[len(keys) for keys, _, _ in unpacked]])
            at = start_of[run] + place
            numbers = np.concatenate([x[3:] for _, x, _ in unpacked], axis=1)[:, at]
            ids = pa.concat_arrays([x for _, _, x in group]).take(pa.array(at))
            names = ids.dictionary_encode()
            rank_of = np.argsort(np.argsort(names.dictionary.to_numpy(zero_copy_only=False), kind="stable"))
            doc = rank_of[names.indices.to_numpy()]
            by = np.lexsort((numbers[0], doc))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (numbers[0][by[1:]] != numbers[0][by[:-1]])
            order = np.empty(len(by), dtype=np.int64)
            order[by] = np.cumsum(new)
            left = [unpacked[r][2][p] for r, p in zip(run.tolist(), place.tolist())]
            shared = np.array(shared)
            shared[0] = 0
            # an anchor of one segment has nothing to settle
            group_of = np.cumsum(shared < 8) - 1
            several = np.flatnonzero(np.bincount(group_of)[group_of] > 1)
            if not len(several):
                continue
            found, least, most = settled(
                shared[several], [left[i] for i in several.tolist()], numbers[:, several], order[several], length, anchor
            )
            found = several[found]
            anchor_at = numbers[0][found]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(found)), pa.array(anchor_at - most), pa.array(anchor_at - least + length)],
                names=["doc_id", "start", "end"],
            )

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(
        merge_ranges, f"doc_id {kind}, start bigint, end bigint"
    )


def run_rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    part, n, run, ids, start, end = zip(*rows)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(run, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for of_run in ids for x in of_run], id_type)),
            pa.array(start, pa.int64()),
            pa.array(end, pa.int64()),
        ],
        names=["part", "n", "run", "ids", "start", "end"],
    )


def deduplicated(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed runs of bytes, and the bytes that stay; a row per row."""
    small_batches(documents)
    texts, unique = one_text_per_id(documents)
    z = packed(texts)
    ranges = removed_ranges(texts, z, length, anchor)
    gone = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    nothing = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("ranges")
    if unique:  # the shuffle of packed texts is the one that the anchors met
        joined = z.join(gone, "doc_id", "left").unionByName(
            packed(documents.where("doc_id IS NULL")).select("doc_id", "z", nothing)
        )
    else:  # ranges are those of one of the texts of an id
        gone = cut_lineage(gone.join(texts.select("doc_id", F.xxhash64("text").alias("_key")), "doc_id"))
        keyed = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
        joined = packed(keyed, "_key").join(gone, ["doc_id", "_key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                sizes, spans, kept = [], [], []
                for z, found in zip(part["z"], part["ranges"].to_pylist()):
                    raw, rest, at = unzip.decompress(z.as_py()), [], 0
                    own = [(s, e) for _, s, e in united([(0, r["start"], r["end"]) for r in found or []])]
                    for s, e in own:
                        rest.append(raw[at:s])
                        at = e
                    sizes.append(len(raw))
                    spans.append([{"start": s, "end": e} for s, e in own])
                    kept.append(b"".join([*rest, raw[at:]]))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return joined.select("doc_id", "z", "ranges").mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
