"""Benchmark decontamination: a broadcast hash set of item windows against the words of documents.

Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased. A window is ``n``
consecutive words of an item, or the whole item if it is shorter. A task hashes every window of
its documents, looks the hashes up, and compares the words themselves where a hash is known.

The hashes are broadcast only up to ``BLOCK_BYTES`` of item text. A larger benchmark is dealt into
blocks of that size, and the documents pass one block after the other in the same scan, without a
shuffle.

Defined results: null and empty texts have no words; items without words have no windows; repeated
items count once; an item without id contaminates but is not counted or named; no items at all
leave everything clean. Documents keep their rows, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwindow.llm.textbytes import LOWER, Powers, byte_set, pieces, runs, windows

#: Bytes of item text whose windows are broadcast at once.
BLOCK_BYTES = 16 << 20

WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
FILTER_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    lowered = LOWER[data]
    starts, ends, _ = runs(WORD_BYTES[lowered], np.array([0, len(data)]))
    raw = lowered.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


@dataclass
class WindowSet:
    """The windows of some items: by length their hashes, and by their words the items."""

    items: dict[bytes, tuple[str | None, ...]]
    hashes: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], n: int) -> WindowSet:
        found: dict[bytes, set] = {}
        lengths: dict[int, list[bytes]] = {}
        for item, text in rows:
            words = words_of(text)
            width = min(n, len(words))
            for i in range(len(words) - width + 1 if words else 0):
                key = b" ".join(words[i : i + width])
                if key not in found:
                    lengths.setdefault(width, []).append(key)
                found.setdefault(key, set()).add(item)
        powers = Powers()
        hashes = {}
        for width, keys in lengths.items():
            joined = np.frombuffer(b" ".join(keys), dtype=np.uint8)
            starts, ends, _ = runs(WORD_BYTES[joined], np.array([0, len(joined)]))
            of_words = powers.spans(powers.sums(joined), starts, ends)
            hashes[width] = np.unique(windows(of_words, width)[::width])
        return cls({k: tuple(v) for k, v in found.items()}, hashes)


class Scan:
    """Finds the windows of a set in the texts of a batch."""

    def __init__(self, known: WindowSet) -> None:
        self.known = known
        self.powers = Powers()
        self.filters = {}
        for width, hashes in known.hashes.items():
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[width] = bits

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, list, set]]:
        """``row, number of words, [(first word, last word + 1)], items`` for every text."""
        for first, last, data, bounds in pieces(texts):
            lowered = LOWER[data]
            starts, ends, rows = runs(WORD_BYTES[lowered], bounds)
            hashes = self.powers.spans(self.powers.sums(lowered), starts, ends)
            counts = np.bincount(rows, minlength=last - first)
            heads = np.concatenate(([0], np.cumsum(counts)))
            hits: dict[int, tuple[list, set]] = {}
            for width, place in self._places(hashes, rows):
                words = [lowered[s:e].tobytes() for s, e in zip(starts[place : place + width], ends[place : place + width])]
                items = self.known.items.get(b" ".join(words))
                if items is not None:
                    row = int(rows[place])
                    spans, named = hits.setdefault(row, ([], set()))
                    spans.append((place - int(heads[row]), place - int(heads[row]) + width))
                    named.update(items)
            for row in range(last - first):
                spans, named = hits.get(row, ([], set()))
                yield first + row, int(counts[row]), spans, named

    def _places(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        for width, bits in self.filters.items():
            h = windows(hashes, width)
            at = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)])
            at = at[rows[at] == rows[at + width - 1]]
            for place in at[np.isin(h[at], self.known.hashes[width])].tolist():
                yield width, place


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, n: int, block_bytes: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """The windows of all items, in as many sets as their size asks for."""
    items = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for b in range(blocks):
        yield WindowSet.of([tuple(r) for r in items.where(block == b).toLocalIterator()], n)


HITS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def contamination(documents: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text, n_words, spans, items``: united hit spans in words, and the items that occur."""
    found = documents.select("doc_id", "text")
    for i, known in enumerate(item_blocks(items, n, block_bytes)):

        def scan(batches: Iterator[pa.RecordBatch], known=known, first=i == 0) -> Iterator[pa.RecordBatch]:
            find = Scan(known)
            for batch in batches:
                counts, spans, names = [], [], []
                for row, n_words, hits, named in find(batch["text"]):
                    if not first:
                        hits = hits + [(s["start"], s["end"]) for s in batch["spans"][row].as_py()]
                        named = named | set(batch["items"][row].as_py())
                    counts.append(n_words)
                    spans.append([{"start": s, "end": e} for s, e in united(hits)])
                    names.append(sorted(x for x in named if x is not None))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        batch["text"],
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        kinds = dict(documents.dtypes)
        found = found.mapInArrow(scan, f"doc_id {kinds['doc_id']}, text string, {HITS}")
    return found


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(documents: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item window occurs, with all their columns."""
    kept = documents
    for known in item_blocks(items, n, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            find = Scan(known)
            for batch in batches:
                yield batch.filter(pa.array([not spans for _, _, spans, _ in find(batch["text"])], pa.bool_()))

        kept = kept.mapInArrow(clean, documents.schema)
    return kept


def cut_spans(documents: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text`` with the hit words, and what stands between them, taken out of the texts."""
    found = contamination(documents, items, n, block_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for row, spans in enumerate(batch["spans"].to_pylist()):
                if spans:
                    raw = texts[row].encode()
                    data = LOWER[np.frombuffer(raw, dtype=np.uint8)]
                    starts, ends, _ = runs(WORD_BYTES[data], np.array([0, len(data)]))
                    kept, at = [], 0
                    for s in spans:
                        kept.append(raw[at : starts[s["start"]]])
                        at = ends[s["end"] - 1]
                    texts[row] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(cut, f"doc_id {dict(documents.dtypes)['doc_id']}, text string")
