r"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Three patterns give the base spans: assignments of a value of 12 or more characters to a name
like ``token``, access keys, and long runs of hex digits. The entropy scan adds spans: candidate
strings are runs of a character class; a window slides over each, the counts of its characters
change by one that enters and one that leaves, and the sum of ``c * log2(c)`` follows from these two
changes alone, in whole numbers, so that no error gathers. Windows at or above the class's
entropy make spans. Candidates that fit the allow list make none.

All of it is column expressions inside the row: no shuffle, no Python. Positions are code points,
ends exclusive. They come from the lengths of matches and of what lies between them.

Defined results: null and empty texts have no spans, and the digest of the empty string; repeated
rows stay; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters fails as a whole, and no later start within it is longer, so the
#: least length can be part of these two patterns. That of ``ASSIGN`` cannot.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST = 12

SCALE = 1 << 20
CHUNK = 256
SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``alphabet`` no shorter than ``window`` are candidates; ``bits`` is the least entropy."""

    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", "[0-9A-Fa-f]{20,}", 20, 3.0),
    CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_=-", "[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
#: Candidates that are no secrets: numbers, words joined by signs, and the alphabet in order.
ALLOWED = (
    r"[0-9]+",
    r"[A-Za-z]+([-_/=+]+[A-Za-z]+)*[-_/=+]*",
    r"(?i).*(abcdefghij|0123456789abcdef|example).*",
)


def starts_of(lengths: Column) -> Column:
    """Running sums of an array before each element, in chunks so that long arrays stay cheap."""

    def folded(values: Column, first: Column) -> Column:
        begin = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, begin, step, lambda s: s["out"])

    def chunked(values: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(first, lambda i: F.slice(values, i, F.lit(CHUNK))), joined)

    def joined(chunks: Column) -> Column:
        total = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(F.zip_with(chunks, folded(total, F.lit(0)), folded))

    return let(lengths, chunked)


def matches(text: Column, pattern: str) -> Column:
    """``start, match`` of all matches of a pattern that never matches nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, 1, F.size(found)), lambda g: F.length(g).cast("bigint"))
    # a match starts after all gaps up to its own and all matches before
    steps = F.zip_with(gaps, found, lambda g, m: g + F.length(m))
    placed = F.arrays_zip(starts_of(steps).alias("at"), gaps.alias("gap"), found.alias("match"))
    full = F.transform(placed, lambda x: F.struct((x["at"] + x["gap"]).alias("start"), x["match"].alias("match")))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<start:bigint,match:string>>")).otherwise(full)


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), F.lit(kind).alias("kind")
        ),
    )


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the three fixed kinds; an assignment's span is the whole match."""
    assigned = F.filter(
        matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= ASSIGN_LEAST
    )
    return {
        "assign": as_spans(assigned, "assign"),
        "access": as_spans(matches(text, ACCESS), "access"),
        "hex": as_spans(matches(text, HEX), "hex"),
    }


def entropy_spans(found: Column, of: CharacterClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of the windows of each candidate that reach the class's entropy, united where they overlap."""
    width = of.window
    # f(c) = c * log2(c); a window's entropy is log2(width) - sum of f / width
    f = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(width + 1)])
    most = math.floor((math.log2(width) - of.bits) * width * SCALE)
    no_spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    suppressed = "^(" + "|".join(f"(?:{a})" for a in allowed) + ")$"

    def scan(m: Column) -> Column:
        codes = F.transform(F.split(m["match"], ""), lambda c: F.instr(F.lit(of.alphabet), c))
        left = F.concat(F.array_repeat(F.lit(0), width), codes)
        moves = F.zip_with(codes, F.slice(left, F.lit(1), F.length(m["match"])), lambda i, o: F.struct(i.alias("i"), o.alias("o")))
        begin = F.struct(
            F.lit(0).cast("bigint").alias("at"),
            F.lit(0).cast("bigint").alias("sum"),
            F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"),
            no_spans.alias("out"),
        )

        def move(s: Column, x: Column) -> Column:
            held = lambda code: F.element_at(s["counts"], code)
            value = lambda n: F.element_at(f, n + 1)
            same = x["i"] == x["o"]
            # first the one that leaves, then the one that enters
            without = F.when((x["o"] == 0) | same, F.lit(0)).otherwise(value(held(x["o"]) - 1) - value(held(x["o"])))
            entered = F.when(same, F.lit(0)).otherwise(value(held(x["i"]) + 1) - value(held(x["i"])))
            total = s["sum"] + without + entered
            counts = F.transform(
                s["counts"],
                lambda n, k: n + (k + 1 == x["i"]).cast("int") - (k + 1 == x["o"]).cast("int"),
            )
            end = s["at"] + 1
            last = F.try_element_at(s["out"], F.lit(-1))
            start = m["start"] + end - width
            hit = (end >= width) & (total <= most)
            span = lambda a: F.array(F.struct(a.alias("start"), (m["start"] + end).alias("end")))
            longer = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), span(last["start"]))
            out = F.when(~hit, s["out"]).when(start <= last["end"], longer).otherwise(F.concat(s["out"], span(start)))
            return F.struct(end.alias("at"), total.cast("bigint").alias("sum"), counts.alias("counts"), out.alias("out"))

        return F.aggregate(moves, begin, move, lambda s: s["out"])

    open_ = F.filter(found, lambda m: ~F.rlike(m["match"], F.lit(suppressed)))
    spans = F.flatten(F.transform(open_, scan))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(of.kind).alias("kind")))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate([*KINDS, *(c.kind for c in CLASSES)]) for x in (k, i)])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("_k"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: the base spans and all spans, in order."""
    text = F.coalesce("text", F.lit(""))
    found = documents.select("doc_id", *_span_columns(text))
    return found.select("doc_id", *_ordered())


def _span_columns(text: Column) -> list[Column]:
    base = base_spans(text)
    return [
        F.concat(*base.values()).alias("_base"),
        *[matches(text, c.pattern).alias(f"_{c.kind}") for c in CLASSES],
    ]


def _ordered() -> list[Column]:
    more = [entropy_spans(F.col(f"_{c.kind}"), c) for c in CLASSES]
    return [in_order(F.col("_base")).alias("base"), in_order(F.concat("_base", *more)).alias("spans")]


def redact(documents: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with every span's text replaced by ``mark``, and ``n_chars`` counted anew."""
    text = F.coalesce("text", F.lit(""))
    columns = documents.columns
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *_span_columns(text))
    held = held.select("_row", _ordered()[1].alias("_spans"))
    text = F.col("_row")["text"]
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def cut(s: Column, x: Column) -> Column:
        between = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        inside = x["start"] < s["at"]  # overlaps with the span before
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(inside, s["out"]).otherwise(F.concat(s["out"], between, F.lit(mark))).alias("out"),
        )

    tail = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("_spans") == 0, text).otherwise(F.aggregate("_spans", begin, cut, tail))
    new = held.select("_row", clean.alias("_clean"))
    return new.select(
        *[
            F.col("_clean").alias(c)
            if c == "text"
            else F.when(F.col("_clean").eqNullSafe(text), F.col("_row")[c]).otherwise(F.length("_clean").cast(k)).alias(c)
            if c == "n_chars"
            else F.col("_row")[c].alias(c)
            for c, k in documents.dtypes
        ]
    )
