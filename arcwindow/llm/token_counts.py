"""Token counts of byte-level BPE vocabularies, by rank-synchronous merging of arrays.

Texts are cut at special strings and into pre-tokens. The pre-tokens not counted before are held
together as one flat array of symbol ids with the piece each belongs to. In a round every piece
finds its lowest-ranked pair, and all occurrences of it in the piece are merged at once, from left to
right; pieces without a known pair are finished. What survives is counted. A round handles all
pieces together, so the number of rounds is that of the longest piece, not of all pieces.

Counts are remembered within a task up to ``REMEMBERED`` pre-tokens; beyond that the memory starts
anew, and only time is lost.

Defined results: a null text is empty and has 0 bytes and 0 tokens; repeated rows stay; columns
other than ``doc_id, text`` are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arcwindow.llm.textbytes import BASE

#: The vocabulary format's own division of texts (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REMEMBERED = 400_000
#: Symbols of pre-tokens that are merged together in one array.
SYMBOLS = 1 << 18
#: Characters of text whose pre-tokens are looked up together.
TOGETHER = 1 << 20
#: Logarithm of the slots in which pairs are looked up before they are compared.
SLOT_BITS = 18
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The characters that stand for the 256 bytes in the file: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file: sorted pair keys, their ranks and what they become."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = model["vocab"]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.keys = np.append(left << 32 | right, -1)
        self.ranks = np.append(np.arange(len(left)), NO_RANK)
        self.merged = np.append(merged, 0)
        # pairs by slot: a pair is one of the few that its slot lists, the last place stands for none
        slots = self.slot(self.keys[:-1])
        order = np.argsort(slots, kind="stable")
        depth = np.arange(len(slots)) - np.searchsorted(slots[order], slots[order])
        self.listed = np.full((depth.max() + 1, 1 << SLOT_BITS), len(left), dtype=np.int32)
        self.listed[depth, slots[order]] = order

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rank, place in the table``; ``NO_RANK`` for pairs that never merge."""
        wanted = left << 32 | right
        slots = self.slot(wanted)
        place = np.full(len(wanted), len(self.keys) - 1, dtype=np.int64)
        open_ = np.arange(len(wanted))
        for listed in self.listed:
            candidate = listed[slots[open_]]
            there = candidate < len(self.keys) - 1
            open_, candidate = open_[there], candidate[there]
            same = self.keys[candidate] == wanted[open_]
            place[open_[same]] = candidate[same]
            open_ = open_[~same]
        return self.ranks[place], place


def surviving(merges: Merges, words: list[bytes]) -> np.ndarray:
    """Number of symbols left of each word when no pair can be merged any more."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    count = np.ones(len(words), dtype=np.int64)
    open_ = np.flatnonzero(lengths > 1)
    piece = np.repeat(open_, lengths[open_])
    symbol = merges.of_byte[np.frombuffer(b"".join(words[i] for i in open_), dtype=np.uint8)]
    while len(symbol):
        rank, place = merges.rank(symbol[:-1], symbol[1:])
        rank[piece[:-1] != piece[1:]] = NO_RANK
        heads = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        sizes = np.diff(np.append(heads, len(piece)))
        lowest = np.minimum.reduceat(np.append(rank, NO_RANK), heads)
        finished = lowest == NO_RANK
        count[piece[heads[finished]]] = sizes[finished]
        if finished.all():
            break
        wins = (rank == np.repeat(lowest, sizes)[:-1]) & (rank != NO_RANK)
        at = np.flatnonzero(wins)
        # of pairs that overlap, as in aaa, every second one from the left
        new_run = np.concatenate(([True], np.diff(at) != 1))
        run_head = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_head) % 2 == 0]
        symbol[at] = merges.merged[place[at]]
        keep = ~np.repeat(finished, sizes)
        keep[at + 1] = False
        symbol, piece = symbol[keep], piece[keep]
    return count


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.merges.special)) if self.merges.special else None
        self.known: dict[str, int] = {}

    def learn(self, distinct: set[str]) -> None:
        """Count the pre-tokens that are not remembered."""
        unknown = distinct.difference(self.known)
        if not unknown:
            return
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known.clear()
            unknown = distinct
        batch: list[str] = []
        size = 0
        for word in unknown:
            batch.append(word)
            size += len(word)
            if size >= SYMBOLS:
                self._add(batch)
                batch, size = [], 0
        self._add(batch)

    def _add(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, surviving(self.merges, [w.encode() for w in words]).tolist()))

    def __call__(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the new pre-tokens of many texts are merged together."""
        counts: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special is not None else [text]
            words = [w for part in parts for w in self.split.findall(part)]
            held.append((len(parts) - 1, words))
            size += len(text)
            if size >= TOGETHER or i == len(texts) - 1:
                self.learn({w for _, words in held for w in words})
                counts += [extra + sum(map(self.known.__getitem__, words)) for extra, words in held]
                held, size = [], 0
        return counts


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``; ``vocabulary`` is a file that every executor has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter(texts), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
