"""Toxicity scores from class-conditional Kneser-Ney models of characters.

Toxic and ordinary text each have an interpolated Kneser-Ney model of byte sequences: counts of the
longest sequences, continuation counts of the shorter ones. Below order ``OWN[0]`` both classes back
off to the same counts, gathered over both, so that a sequence nobody knows speaks for neither class,
and a rare expression is judged by the longest part of it that either class has seen.

The models are stored as in back-off files: a sequence seen by either class has the logarithm of
the ratio of its two probabilities, a context the logarithm of the ratio of its two back-off
weights. Look-ups are exact. A text is scored by look-ups. Its evidence is the log-likelihood ratio per byte, of the
whole text and of its most toxic ``SPAN`` bytes, so that a short insult in a long text counts. A
logistic curve, fitted on rows the models were not counted on, makes a probability of these.

Sequences are counted in Spark over all labelled rows that are not held out, of any length: partial
counts per task, then one shuffle. Only the logistic curve is fitted on a sample, half of the labelled
rows or about ``PER_CLASS / 2`` of each class, of up to ``TEXT_BYTES``, whose counts are added after it.
All sequences make the tables. Where a class has more than ``MOST`` of them, the model is made in parts: what is
looked up for one byte shares the ``LOWEST`` bytes before it, so a hash of these deals sequences, contexts and the bytes of
texts out to parts that need nothing of one another but the shared short sequences, of which there are few. The driver
makes one part at a time and broadcasts it; a task loads one at a time for about ``GROUP_BYTES`` of texts. Every text
is scored whole.

Defined results: a null text is an empty one and has no evidence; without labels of both classes
all scores are ``UNKNOWN``, below every threshold; repeated rows stay; columns other than ``doc_id, text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.llm.labelled import (
    PER_CLASS,
    TEXT_BYTES,
    UNKNOWN,
    hash_order,
    hashed_share,
    held_out,
    known_labels,
    logistic,
    on_curve,
)
from arcwindow.llm.textbytes import BASE, LOWER, PIECE_BYTES, byte_set
from arcwindow.plans.scratch import cut_lineage

#: Orders that each class counts for itself; shorter sequences are counted together.
OWN = (4, 5, 6)
DISCOUNT = 0.75
#: Logarithm of the least number of slots, by order; more sequences have more, ``SLOTS_EACH`` and up to ``MOST_BITS``.
SLOT_BITS = {3: 17, 4: 19, 5: 20, 6: 21}
SLOTS_EACH = 4
MOST_BITS = 23
#: The same for keys that met others in a slot; a mark has 31 bits.
LEAST_BITS = 17
#: Sequences of each class in a part of the model, about, and those a task gathers before it passes them on.
MOST = 1 << 20
GATHERED = 1 << 21
#: Bytes of texts for which a task loads all parts once, where there are several.
GROUP_BYTES = 1 << 25
#: A sequence and its class as one number.
CLASS_BIT = 8 * OWN[-1]
#: The longest sequences that the classes share, and the bytes that deal out to parts.
LOWEST = OWN[0] - 1
#: Deals bytes out to parts, in numpy and SQL alike: factor and shift.
PART_FACTOR, PART_SHIFT = 2654435761, 16
SPAN = 48
GAP = b" " * max(OWN)

#: Letters lower-cased, digits alike, all else a space.
FORM = np.where(byte_set((0x61, 0x7A), (0x80, 0xFF))[LOWER], LOWER, np.uint8(32)).astype(np.uint8)
FORM[0x30:0x3A] = 0x30


def formed(texts: list[bytes]) -> np.ndarray:
    """The texts one after the other, each after a gap, and a gap at the end."""
    return FORM[np.frombuffer(GAP + b"".join(t + GAP for t in texts), dtype=np.uint8)]


def sequences(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes that end at each place, as a number; places before the first whole one are left out."""
    wide = data.astype(np.uint64)
    code = wide[n - 1 :].copy()
    for back in range(1, n):
        code |= wide[n - 1 - back : len(wide) - back] << np.uint64(8 * back)
    return code


def suffix(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes."""
    return codes & np.uint64((1 << 8 * n) - 1)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0.0)


class Order:
    """Counts of one order: sequences, their contexts' totals and back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = codes, counts.astype(float)
        self.contexts, place = np.unique(codes >> np.uint64(8), return_inverse=True)
        self.totals = np.bincount(place, weights=self.counts, minlength=len(self.contexts))
        kinds = np.bincount(place, minlength=len(self.contexts))
        self.backoff = DISCOUNT * kinds / np.maximum(self.totals, 1e-9)

    def probability(self, codes: np.ndarray, low: np.ndarray) -> np.ndarray:
        context = codes >> np.uint64(8)
        total = look_up(self.contexts, self.totals, context)
        known = total > 0
        own = np.maximum(look_up(self.codes, self.counts, codes) - DISCOUNT, 0) / np.where(known, total, 1)
        return own + np.where(known, look_up(self.contexts, self.backoff, context), 1.0) * low


def continuations(codes: np.ndarray, n: int) -> Order:
    """How many different bytes come before each sequence of ``n`` bytes, given those of ``n + 1``."""
    return Order(*np.unique(suffix(codes, n), return_counts=True))


Counts = tuple[np.ndarray, np.ndarray]


def added(parts: list[Counts]) -> Counts:
    """The numbers of all parts, sorted, and the sums of their counts."""
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    sums = np.zeros(len(codes), dtype=np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return codes, sums


def text_sequences(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The longest sequences that end in a text or in the gap after it, however the texts are dealt out."""
    data, n = formed(texts), OWN[-1]
    for first in range(1, len(data) - n + 1, PIECE_BYTES):
        yield sequences(data[first : first + PIECE_BYTES + n - 1], n)


def counted(texts: list[bytes]) -> Counts:
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for codes in text_sequences(texts):
        parts.append(np.unique(codes, return_counts=True))
        if sum(len(c) for c, _ in parts) > GATHERED:
            parts = [added(parts)]
    return added(parts)


def class_counts(rows: DataFrame) -> DataFrame:
    """``label, code, n`` of all sequences in rows of ``label, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def packed(found: Counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["key", "n"])

        for batch in batches:
            texts = {0: [], 1: []}
            for y, text in zip(batch["label"].to_pylist(), batch["text"]):
                texts[y].append((text.as_py() or "").encode())
            for y, of_class in texts.items():
                for codes in text_sequences(of_class) if of_class else ():
                    parts.append(np.unique(codes | np.uint64(y << CLASS_BIT), return_counts=True))
                    size += len(parts[-1][0])
                    if size > GATHERED:
                        parts = [added(parts)]
                        size = len(parts[0][0])
                        if size > GATHERED // 2:
                            yield packed(parts[0])
                            parts, size = [], 0
        if parts:
            yield packed(added(parts))

    sums = rows.select("label", "text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    code = F.col("key").bitwiseAND((1 << CLASS_BIT) - 1)
    return sums.select(F.shiftright("key", CLASS_BIT).cast("int").alias("label"), code.alias("code"), "n")


def commonest(counts: DataFrame, most: int) -> dict[int, Counts]:
    """By class the sequences and counts, without the rarest where there are more than ``most``: for callers who ask for a
    bounded model."""
    counts = cut_lineage(counts)
    least, seen = {}, {0: 0, 1: 0}
    # a class has far fewer different counts than sequences
    for y, n, sequences_of_n in sorted(counts.groupBy("label", "n").count().collect(), key=lambda r: -r["n"]):
        seen[y] += sequences_of_n
        if seen[y] <= most:
            least[y] = n
    found = {}
    for y in (0, 1):
        kept = counts.where((F.col("label") == y) & (F.col("n") >= least[y])) if y in least else counts.where("false")
        found[y] = taken(kept)
    return found


def taken(counts: DataFrame) -> Counts:
    """``code, n`` on the driver, in order."""
    rows = counts.select("code", "n").toArrow()
    return added([(rows["code"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(np.int64))])


def part_of(before: np.ndarray, parts: int) -> np.ndarray:
    """The part of the model that knows what follows these ``LOWEST`` bytes."""
    return (before * np.uint64(PART_FACTOR) >> np.uint64(PART_SHIFT)) % np.uint64(parts)


def before_last(codes: np.ndarray) -> np.ndarray:
    """The ``LOWEST`` bytes before the last one."""
    return suffix(codes >> np.uint64(8), LOWEST)


def part_column(code: Column, parts: int) -> Column:
    before = F.shiftright(code, 8).bitwiseAND((1 << 8 * LOWEST) - 1)
    return F.shiftright(before * F.lit(PART_FACTOR).cast("bigint"), PART_SHIFT) % parts


class Parts:
    """Counts by class, a part at a time; ``most`` sequences of a class in a part, about."""

    def __init__(self, counts: DataFrame, most: int) -> None:
        counts = cut_lineage(counts)
        sizes = [r["count"] for r in counts.groupBy("label").count().collect()]
        self.parts, self.both = max(1, -(-max(sizes, default=0) // most)), len(sizes) == 2
        if self.parts > 1:
            dealt = counts.withColumn("part", part_column(F.col("code"), self.parts))
            counts = cut_lineage(dealt.repartition(self.parts, "part").sortWithinPartitions("part"))
        self.counts = counts

    def __call__(self, part: int) -> dict[int, Counts]:
        counts = self.counts if self.parts == 1 else self.counts.where(F.col("part") == part)
        return {y: taken(counts.where(F.col("label") == y)) for y in (0, 1)}


def class_orders(data: np.ndarray) -> dict[int, Order]:
    return orders_of(*np.unique(sequences(data, OWN[-1]), return_counts=True))


def orders_of(codes: np.ndarray, counts: np.ndarray) -> dict[int, Order]:
    top = OWN[-1]
    orders = {top: Order(codes, counts)}
    for n in reversed(OWN[:-1]):
        orders[n] = continuations(orders[n + 1].codes, n)
    return orders


@dataclass
class Table:
    """Slots of what tells a key from others of its slot, the ratio and the back-off, the last two as half floats.

    A key is mixed one to one; its slot is the beginning of the result and the slot holds the rest, so keys are told apart
    exactly. Where keys meet in a slot the commonest stays, the others go to the table ``more``.
    """

    slots: np.ndarray
    bits: int
    turn: int = 0
    more: Table | None = None

    @classmethod
    def of(
        cls, n: int, codes: np.ndarray, weight: np.ndarray, ratio: np.ndarray, backoff: np.ndarray, turn: int = 0
    ) -> Table:
        wanted = int(SLOTS_EACH * len(codes)).bit_length()
        bits = max(LEAST_BITS if turn else SLOT_BITS[n], min(wanted, MOST_BITS))
        at, mark = cls.place(codes, bits, turn)
        slots = np.zeros(1 << bits, dtype=np.uint64)
        order = np.argsort(weight, kind="stable")  # the commonest is written last
        halves = [x.astype(np.float16).view(np.uint16).astype(np.uint64) for x in (ratio, backoff)]
        packed = mark << np.uint64(32) | halves[0] << np.uint64(16) | halves[1]
        slots[at[order]] = packed[order]
        lost = np.flatnonzero(slots[at] >> np.uint64(32) != mark)
        more = cls.of(n, codes[lost], weight[lost], ratio[lost], backoff[lost], turn + 1) if len(lost) else None
        return cls(slots, bits, turn, more)

    @staticmethod
    def place(codes: np.ndarray, bits: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and mark; a mark is never 0. Each turn mixes in another way."""
        whole, half = np.uint64((1 << CLASS_BIT) - 1), np.uint64(CLASS_BIT // 2)
        h = codes * np.uint64(BASE * (2 * turn + 1) % (1 << 64)) & whole
        h ^= h >> half
        h = h * np.uint64(BASE) & whole
        rest = np.uint64(CLASS_BIT - bits)
        return (h >> rest).astype(np.int64), h & np.uint64((1 << int(rest)) - 1) | np.uint64(1 << 31)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``known, ratio, back-off``."""
        at, mark = self.place(codes, self.bits, self.turn)
        found = self.slots[at]
        known = found >> np.uint64(32) == mark
        ratio = (found >> np.uint64(16)).astype(np.uint16).view(np.float16).astype(np.float32)
        backoff = np.where(known, found.astype(np.uint16).view(np.float16).astype(np.float32), np.float32(0))
        if self.more is not None:
            left = np.flatnonzero((found > 0) & ~known)
            known[left], ratio[left], backoff[left] = self.more(codes[left])
        return known, ratio, backoff


@dataclass
class Part:
    """What follows some of the ``LOWEST`` bytes: ratios of sequences by order, and of back-offs by that of the context."""

    tables: dict[int, Table]
    after: dict[int, Table]

    def fill(self, data: np.ndarray, ratio: np.ndarray, part: int, parts: int) -> None:
        """Set the ratio of every byte of ``data`` that is of this part; those of the first gap have none."""
        top = OWN[-1]
        codes = sequences(data, top)
        left = np.arange(len(codes)) if parts == 1 else np.flatnonzero(part_of(before_last(codes), parts) == part)
        backed = np.zeros(len(left), dtype=np.float32)
        for n in reversed(OWN):
            known, own, _ = self.tables[n](suffix(codes[left], n))
            ratio[left[known] + top - 1] = backed[known] + own[known]
            left, backed = left[~known], backed[~known]
            # the context of the sequence that ends at a place ends one before
            backed += self.after[n - 1](suffix(codes[left] >> np.uint64(8), n - 1))[2]
        ratio[left + top - 1] = backed


@dataclass
class Sent:
    """A part that was broadcast, loaded anew each time so that only one is held."""

    broadcast: Broadcast

    def load(self) -> Part:
        part = self.broadcast.value
        if getattr(self.broadcast, "_path", None):
            self.broadcast.__dict__.pop("_value", None)
        return part


@dataclass
class Model:
    parts: list[Part] | list[Sent]
    weights: np.ndarray

    @property
    def tables(self) -> dict[int, Table]:
        """The tables of a model of one part."""
        (part,) = self.parts
        return part.tables

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text the ratio of its most toxic span and of the whole, both per byte, and the log of its length."""
        out, group, first, size, held = [np.zeros((0, 3))], [], 0, 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= PIECE_BYTES or i == len(texts) - 1:
                group.append(texts[first : i + 1])
                first, held, size = i + 1, held + size, 0
                if len(self.parts) == 1 or held >= GROUP_BYTES or first == len(texts):
                    out += self._evidence(group)
                    group, held = [], 0
        return np.concatenate(out)

    def _evidence(self, group: list[list[bytes]]) -> list[np.ndarray]:
        filled = [(data := formed(texts), np.zeros(len(data), dtype=np.float32)) for texts in group]
        for k, part in enumerate(self.parts):
            part = part.load() if isinstance(part, Sent) else part
            for data, ratio in filled:
                part.fill(data, ratio, k, len(self.parts))
        return [summed(texts, ratio) for texts, (_, ratio) in zip(group, filled)]


def summed(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """The evidence of texts whose bytes have these ratios."""
    ends = np.cumsum([len(t) + len(GAP) for t in texts]) + len(GAP)
    starts = np.concatenate(([len(GAP)], ends[:-1]))
    total = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
    lengths = np.array([len(t) for t in texts], dtype=float)
    mean = (total[ends] - total[starts]) / np.maximum(lengths, 1)
    # a span is whole within its text, or the text and what follows of its gap
    spans = np.full(len(ratio) + SPAN, -np.inf)
    if len(ratio) >= SPAN:
        spans[: len(ratio) - SPAN + 1] = (total[SPAN:] - total[:-SPAN]) / SPAN
    best = np.maximum.reduceat(spans, np.stack([starts, np.maximum(ends - SPAN, starts) + 1], 1).ravel())[::2]
    best = np.where(lengths < SPAN, (total[ends] - total[starts]) / SPAN, best)
    return np.column_stack([best, mean, np.log1p(lengths)])


def shared_orders(counts: Callable[[int], dict[int, Counts]], parts: int) -> dict[int, Order]:
    """The short sequences of both classes: how many different bytes come before each, over all parts."""
    seen = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for k in range(parts):
        codes = np.unique(suffix(np.concatenate([codes for codes, _ in counts(k).values()]), OWN[0]))
        seen = [added([*seen, np.unique(suffix(codes, LOWEST), return_counts=True)])]
    shared = {LOWEST: Order(*seen[0])}
    for n in range(LOWEST - 1, 0, -1):
        shared[n] = continuations(shared[n + 1].codes, n)
    return shared


def build(classes: list[dict[int, Order]], shared: dict[int, Order]) -> Part:
    lowest = OWN[0]

    def shared_probability(codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 256)
        for n in range(1, lowest):
            p = shared[n].probability(suffix(codes, n), p)
        return p

    def weights_of(codes: np.ndarray, n: int) -> np.ndarray:
        """The ratio of the back-off weights after ``codes``, contexts of order ``n``."""
        toxic, ordinary = (look_up(c[n].contexts, c[n].backoff, codes) for c in classes)
        return np.log(np.where(toxic > 0, toxic, 1.0)) - np.log(np.where(ordinary > 0, ordinary, 1.0))

    tables, after = {}, {}
    for n in OWN:
        contexts = np.unique(np.concatenate([c[n].contexts for c in classes]))
        zeros = np.zeros(len(contexts))
        after[n - 1] = Table.of(n - 1, contexts, zeros, zeros, weights_of(contexts, n))
        codes = np.unique(np.concatenate([c[n].codes for c in classes]))
        logs = []
        for c in classes:
            p = shared_probability(suffix(codes, lowest - 1))
            for m in range(lowest, n + 1):
                p = c[m].probability(suffix(codes, m), p)
            logs.append(np.log(p))
        count = sum(look_up(c[n].codes, c[n].counts, codes) for c in classes)
        tables[n] = Table.of(n, codes, count, logs[0] - logs[1], np.zeros(len(codes)))
    return Part(tables, after)


def fit(sample: list[tuple[int, str]]) -> Model | None:
    """A model of these rows only: one half is counted, and the curve fitted on the other."""
    return fit_counts({k: counted([t.encode() for y, t in sample[::2] if y == k]) for k in (0, 1)}, sample[1::2])


def fit_counts(counts: dict[int, Counts], curve: list[tuple[int, str]]) -> Model | None:
    """A model of counts by class, and of rows without part in them that give the curve."""
    return fit_parts(lambda _: counts, 1, curve) if all(len(codes) for codes, _ in counts.values()) else None


def fit_parts(
    counts: Callable[[int], dict[int, Counts]], parts: int, curve: list[tuple[int, str]], send: Callable[[Part], Sent] | None = None
) -> Model | None:
    """The same with counts that come a part at a time; ``send`` takes the parts of the model where there are several."""
    rows = [(y, t.encode()) for y, t in curve]
    if {y for y, _ in rows} != {0, 1}:
        return None
    own = {k: counted([t for y, t in rows if y == k]) for k in (0, 1)}

    def whole(part: int) -> dict[int, Counts]:
        """The counts, and those of the curve's rows."""
        at = {k: part_of(before_last(codes), parts) == part for k, (codes, _) in own.items()}
        return {k: added([found, (own[k][0][at[k]], own[k][1][at[k]])]) for k, found in counts(part).items()}

    def made(source: Callable[[int], dict[int, Counts]]) -> list[Part] | list[Sent]:
        shared = shared_orders(source, parts)
        built = (build([orders_of(*of_class) for of_class in (found[1], found[0])], shared) for found in map(source, range(parts)))
        return [send(part) if send else part for part in built]

    first = Model(made(counts), np.zeros(4))
    x = first.evidence([t for _, t in rows])
    weights = logistic(x, np.array([y for y, _ in rows], dtype=float))
    for part in first.parts:
        if isinstance(part, Sent):
            part.broadcast.destroy()
    return Model(made(whole), weights)


def learn(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    fold: int,
    per_class: int = PER_CLASS,
    most: int = MOST,
    bound: int | None = None,
) -> Model | None:
    """Fit the model on all labelled rows that are not held out, in parts of about ``most`` sequences of a class.

    With ``bound``, a model of the commonest sequences only, that many of each class.
    """
    known = known_labels(labels, label, folds, fold)
    sizes = dict(known.groupBy("label").count().collect())
    if set(sizes) != {0, 1}:
        return None
    shares = [F.lit(x) for k, n in sizes.items() for x in (k, min(0.5, per_class / 2 / n))]
    known = known.withColumn("on_curve", hashed_share(F.element_at(F.create_map(*shares), F.col("label")), "doc_id"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = F.octet_length("text") <= TEXT_BYTES
    # label tables grow with the documents, so both are shuffled at any size; only the ids of the sample are broadcast
    counts = class_counts(texts.join(known.hint("merge"), "doc_id").where(~(F.col("on_curve") & short)))
    sample = texts.join(F.broadcast(known.where("on_curve")), "doc_id").where(short)
    rows = sorted(sample.toLocalIterator(), key=lambda r: (hash_order(r["doc_id"]), r["text"]))
    curve = [(r["label"], r["text"]) for r in rows]
    if bound is not None:
        return fit_counts(commonest(counts, bound), curve)
    found = Parts(counts, most)
    if found.parts == 1:
        return fit_counts(found(0), curve)
    if not found.both:
        return None
    sc = documents.sparkSession.sparkContext
    return fit_parts(found, found.parts, curve, lambda part: Sent(sc.broadcast(part)))


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2
) -> DataFrame:
    """``doc_id, held_out, score``; the score is the probability of label 1."""
    model = learn(documents, labels, label, folds, fold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["text"]]
            scores = on_curve(model.evidence(texts), model.weights) if model else np.full(len(texts), UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    rows = documents.select("doc_id", held_out(folds, fold).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
