"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Tokens that overlap belong together, and so does what is connected by overlaps;
these groups end where tokens of both end. Every token points to the token overlapping it that ends
farthest to the right; of two that end together the second tokenizer's is the farther one. A token that points to
itself is the terminal token of its group. Replacing all successors by their successors' successors doubles the steps,
so after a logarithm of the longest chain every token points to its group's terminal token, whose place labels
the group. All texts of a piece are one array: a text's end is an end of both.

Links are the pairs of a first and a second tokenizer's token in one group. For each text the distinct pairs of ids and how
often they occur are written. Counting in how many texts a pair occurs is one aggregation of these. Texts then look the
counts up: those of the ``KNOWN`` commonest pairs at most, told by the counts' histogram, in sorted arrays that tasks are
given; all others in a join. A pair of the join is rarer than ``KNOWN`` others, so none of its keys is hot.

Defined results: a text that is null or empty, or whose tokens' bytes differ from a space and the text, has no tokens;
repeated rows are texts of their own; an empty table gives an empty result; columns other than ``doc_id, text``
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwindow.llm.links import small_batches
from arcwindow.llm.token_counts import byte_symbols
from arcwindow.plans.scratch import cut_lineage

#: Bytes of text that are tokenized and aligned together; a longer text is alone.
TOGETHER = 1 << 19
#: Pairs of ids whose counts are handed to all tasks at most.
KNOWN = 1 << 18
#: Parts of texts whose tokens a task remembers.
REMEMBERED = 400_000
#: Parts that are tokenized as one text.
JOINED = 4096
#: Spaces before which a tokenizer may not cut.
UNSURE = re.compile(r"(?:^|[^!-~]) | \Z")
#: Tokens of one side from which a group's ids are made distinct before they are paired.
LARGE_GROUP = 8


class Tokenizers:
    """Two tokenizers: ids of texts, the bytes of each id, and ids written as text.

    Both cut before a space that follows a visible ASCII sign: the first because its pattern lets no token have
    white space after anything else, the second if no piece has a space after anything else. So texts are cut there, and
    parts are tokenized once and remembered within a task, up to ``REMEMBERED`` of them.
    """

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        of_symbol = {s: bytes([i]) for i, s in enumerate(byte_symbols())}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [b"".join(of_symbol.get(c, c.encode()) for c in t) for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        with open(first, encoding="utf-8") as f:
            file = json.load(f)
        own_pattern = file["pre_tokenizer"] or {}
        self.in_parts = (
            file["normalizer"] is None
            and own_pattern.get("type") == "ByteLevel"
            and own_pattern.get("use_regex", True)
            and not own_pattern.get("add_prefix_space", True)
            and not any(re.search("[^▁]▁", p) for p in pieces)
            and self.b.encode("a  b c", out_type=str)[:1] == ["▁a"]
            and b"".join(self.b_bytes[i] for i in self.b.encode("a  b ")) == b" a  b "
        )
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as digits with what may follow them; rows are filled up with zeros
        names = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]
        width = max(map(len, names))
        self.digits = np.frombuffer("".join(x.ljust(width, "\0") for x in names).encode(), dtype=np.uint8).reshape(-1, width)
        self.digit_lengths = np.array([len(x) for x in names], dtype=np.int64)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.unequal: set[str] = set()

    @property
    def n_second(self) -> int:
        return len(self.b_bytes)

    def parts(self, text: str) -> list[str]:
        """The text cut at spaces before which both tokenizers cut; the space is left out."""
        if not self.in_parts:
            return [text]
        words = text.split(" ")
        if UNSURE.search(text) is None:
            return words
        joined = words[:1]
        for word in words[1:]:
            if word and joined[-1] and "!" <= joined[-1][-1] <= "~":
                joined.append(word)
            else:
                joined[-1] += " " + word
        return joined

    def learn(self, parts: set[str]) -> None:
        unknown = list(parts.difference(self.known_a))
        if not unknown:
            return
        if len(self.known_a) + len(unknown) > REMEMBERED:
            for known in (self.known_a, self.known_b, self.unequal):
                known.clear()
            unknown = list(parts)
        # parts before which and after which both cut are tokenized as one text
        joined, alone = [], []
        for part in unknown:
            (joined if part and "!" <= part[-1] <= "~" and self.in_parts else alone).append(part)
        for first in range(0, len(joined), JOINED):
            self.learn_joined(joined[first : first + JOINED])
        self.learn_alone(alone)

    def learn_joined(self, parts: list[str]) -> None:
        text = " ".join(parts)
        raw = (" " + text).encode()
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        # the second tokenizer puts a space before its text
        both = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        found = []
        for ids, known, lengths in zip(both, (self.a_bytes, self.b_bytes), (self.a_lengths, self.b_lengths)):
            at = np.cumsum(lengths[ids])
            cuts = np.searchsorted(at, ends)
            if b"".join(map(known.__getitem__, ids)) != raw or not np.array_equal(at[np.minimum(cuts, len(at) - 1)], ends):
                return self.learn_alone(parts)
            found.append((np.array(ids, dtype=np.int32).tobytes(), [0, *(4 * (cuts + 1)).tolist()]))
        for known, (ids, cuts) in zip((self.known_a, self.known_b), found):
            known.update(zip(parts, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))

    def learn_alone(self, parts: list[str]) -> None:
        both = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False), self.b.encode(parts, num_threads=1)
        for part, a, b in zip(parts, *both):
            raw = (" " + part).encode()
            if b"".join(map(self.a_bytes.__getitem__, a.ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                self.unequal.add(part)
            self.known_a[part] = np.array(a.ids, dtype=np.int32).tobytes()
            self.known_b[part] = np.array(b, dtype=np.int32).tobytes()

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text by both tokenizers; none where their bytes are not those of a space and the text."""
        cut = [self.parts(t) if t else [] for t in texts]
        self.learn({p for parts in cut for p in parts})
        if self.unequal:
            cut = [parts if self.unequal.isdisjoint(parts) else [] for parts in cut]
        return tuple([b"".join(map(known.__getitem__, parts)) for parts in cut] for known in (self.known_a, self.known_b))


class Groups:
    """The groups of the tokens of several texts."""

    def __init__(self, tokenizers: Tokenizers, a: list[bytes], b: list[bytes]) -> None:
        self.tokenizers = tokenizers
        self.a, self.b = (np.frombuffer(b"".join(x), dtype=np.int32).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([len(ids) // 4 for ids in x], dtype=np.int64) for x in (a, b))
        a_lengths, b_lengths = tokenizers.a_lengths[self.a], tokenizers.b_lengths[self.b]
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        n = len(self.a)
        # farthest-right overlapping token: the other side's last one that starts before this one's end
        successor = np.empty(n + len(self.b), dtype=np.int64)
        successor[:n] = n + np.searchsorted(b_ends - b_lengths, a_ends) - 1
        over = np.searchsorted(a_ends - a_lengths, b_ends) - 1
        successor[n:] = np.where(a_ends[over] > b_ends, over, n + np.arange(len(self.b))) if len(self.b) else over
        while True:
            further = successor[successor]
            if np.array_equal(further, successor):
                break
            successor = further
        terminal = successor[n:] == n + np.arange(len(self.b))
        number = np.cumsum(terminal) - 1
        self.a_group, self.b_group = number[successor[:n] - n], number[successor[n:] - n]
        self.n_groups = int(terminal.sum())
        text_of_b = np.repeat(np.arange(len(b)), self.n_b)
        self.text = text_of_b[terminal]
        self.a_size, self.b_size = (np.bincount(g, minlength=self.n_groups) for g in (self.a_group, self.b_group))

    def per_text(self, amounts: np.ndarray | None = None) -> np.ndarray:
        """Groups of each text, or a sum over them."""
        if amounts is None:
            return np.bincount(self.text, minlength=len(self.n_a))
        out = np.zeros(len(self.n_a), dtype=np.int64)
        np.add.at(out, self.text, amounts)
        return out

    def written(self) -> list[bytes]:
        """Each text's groups: ids of both sides, in order."""
        known = self.tokenizers
        a_last, b_last = (np.append(g[1:] != g[:-1], np.ones(min(len(g), 1), dtype=bool)) for g in (self.a_group, self.b_group))
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        b_before, a_through = np.cumsum(self.b_size) - self.b_size, np.cumsum(self.a_size)
        code[np.arange(len(self.a)) + b_before[self.a_group]] = 2 * self.a + a_last
        code[np.arange(len(self.b)) + a_through[self.b_group]] = 2 * (len(known.a_bytes) + self.b) + b_last
        flat = known.digits[code].ravel()
        flat = flat[flat != 0].tobytes()
        at = np.concatenate(([0], np.cumsum(known.digit_lengths[code])))
        cuts = at[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [flat[first : max(last - 1, first)] for first, last in zip(cuts[:-1], cuts[1:])]  # without the last sign

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``pair, times, n``: distinct linked pairs text by text, how often each occurs, and how many a text has."""
        large = (self.a_size > LARGE_GROUP) | (self.b_size > LARGE_GROUP)
        sides = []
        for ids, group in ((self.a, self.a_group), (self.b, self.b_group)):
            in_large = large[group]
            small = ids[~in_large], group[~in_large], np.ones(int((~in_large).sum()), dtype=np.int64)
            wide = 1 << 32
            key, times = np.unique(group[in_large] * wide + ids[in_large], return_counts=True)
            joined = [np.concatenate(x) for x in zip(small, (key % wide, key // wide, times))]
            order = np.argsort(joined[1], kind="stable")
            sides.append([x[order] for x in joined])
        (a, a_group, a_times), (b, b_group, b_times) = sides
        first = np.searchsorted(b_group, np.arange(self.n_groups))
        n_b = np.diff(np.append(first, len(b_group)))
        partners = n_b[a_group]
        left = np.repeat(np.arange(len(a)), partners)
        right = np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners) + first[a_group[left]]
        pair = a[left] * self.tokenizers.n_second + b[right]
        text, times = self.text[a_group[left]], a_times[left] * b_times[right]
        span = len(self.tokenizers.a_bytes) * self.tokenizers.n_second
        key = text * span + pair
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(times[order], heads) if len(key) else times
        return key[heads] % span, total, np.bincount(key[heads] // span, minlength=len(self.n_a))


def grouped(texts: pa.Array, tokenizers: Tokenizers) -> Iterator[Groups]:
    """Groups of the texts, a bounded number of bytes together."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER or i == len(texts) - 1:
            yield Groups(tokenizers, *tokenizers(held))
            held, size = [], 0


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, kind))


def token_groups(documents: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_group, b_group``: tokens of both, and the group of each, from 0 in each text."""
    kind = dict(documents.dtypes)["doc_id"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(first, second)
        for batch in batches:
            done = 0
            for g in grouped(batch["text"], tokenizers):
                start = np.cumsum(g.per_text()) - g.per_text()
                sides = [(g.a, g.n_a, g.a_group), (g.b, g.n_b, g.b_group)]
                ids = [lists(x, n, pa.int32()) for x, n, _ in sides]
                groups = [lists(group - np.repeat(start, n), n, pa.int32()) for _, n, group in sides]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(done, len(g.n_a)), *ids, *groups], names=["doc_id", "a_ids", "b_ids", "a_group", "b_group"]
                )
                done += len(g.n_a)

    schema = f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"
    small_batches(documents)
    return documents.select("doc_id", "text").mapInArrow(align, schema)


def linked(documents: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``; a pair is ``a * pieces of the second + b``."""
    kind = dict(documents.dtypes)["doc_id"]
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(first, second)
        for batch in batches:
            done = 0
            for g in grouped(batch["text"], tokenizers):
                pair, times, n = g.pairs()
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in g.written()]
                counts = [g.n_a, g.n_b, g.per_text(), g.per_text(g.a_size * g.b_size)]
                arrays = [*[pa.array(x, pa.int64()) for x in counts], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(done, len(g.n_a)), *arrays, lists(pair, n, pa.int64()), lists(times, n, pa.int64())],
                    names=["doc_id", *numbers, "groups_sha256", "pairs", "times"],
                )
                done += len(g.n_a)

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in numbers)}, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    small_batches(documents)
    return documents.select("doc_id", "text").mapInArrow(align, schema)


def pair_counts(texts: DataFrame, n_second: int) -> DataFrame:
    """``pair, n, best``: texts that hold each linked pair, and whether no pair of its first id is in more."""
    counted = cut_lineage(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    of_first = F.expr(f"pair div {n_second}")
    # a row for each id of the first vocabulary at most
    most = counted.groupBy(of_first.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", of_first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(documents: DataFrame, first: str, second: str, n_second: int | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row per row of the documents.

    ``first`` is a file of byte-level BPE for the library tokenizers, ``second`` one for sentencepiece; every
    executor has both.
    """
    if n_second is None:
        from sentencepiece import SentencePieceProcessor

        n_second = SentencePieceProcessor(model_file=second).get_piece_size()
    texts = cut_lineage(linked(documents, first, second).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(texts, n_second))
    # the histogram by powers of two has 64 rows at most
    steps = counts.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    common, held = 1 << 62, 0
    for bits, n in steps:
        held += n
        if held > KNOWN:
            break
        common = 1 << (bits - 1)
    table = counts.where(F.col("n") >= common).toArrow()
    pair, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], best[order].astype(np.int64)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, times = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            row = np.repeat(np.arange(len(batch)), np.diff(batch["pairs"].offsets.to_numpy()))
            place = np.searchsorted(pair, flat)
            place[place == len(pair)] = 0
            there = pair[place] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            sums = []
            for amount in (best, n):
                total = np.zeros(len(batch), dtype=np.int64)
                np.add.at(total, row[there], amount[place[there]] * times[there])
                sums.append(pa.array(total))
            left = np.bincount(row[~there], minlength=len(batch))
            rest = [lists(x[~there], left, pa.int64()) for x in (flat, times)]
            kept = [batch[c] for c in names if c not in ("n_best", "count_sum")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *rest], names=[*names, "pairs", "times"])

    kinds = dict(texts.dtypes)
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = [*own, "n_best", "count_sum"]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in own], "n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"])
    found = cut_lineage(texts.select(*own, "pairs", "times").mapInArrow(look_up, schema))
    rare = counts.where(F.col("n") < common)
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    rest = rest.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more")
    )
    total = found.drop("pairs", "times").join(rest, "row", "left")
    return total.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
