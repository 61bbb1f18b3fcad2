"""Context extraction: which tokens near a target are its features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import all_distinct, let, where_here
from arcwindow.functions.tokens import (
    DEFAULT_FORMAT,
    DEFAULT_TOKEN_SEP,
    TOKENS,
    format_tokens,
    other_columns,
)
from arcwindow.operators.filters import Words, keep_listed, word_table
from arcwindow.operators.matchers import Matcher, Unigrams, prepared

NOT_KEYS = ("text_open", "is_tail")
#: Targets of a long chunk that stay together when it is dealt out.
TOGETHER = 512

# Arrays are opened with explode_outer and a null test after it: for plain explode the
# optimizer adds "size(array) > 0" below, and so evaluates the whole matching twice.


class FeatureExtractor(Protocol):
    def positions(self, n: Column, left: Column, right: Column) -> Column: ...

    def marker(self, position: Column, left: Column, right: Column) -> Column: ...


@dataclass(frozen=True)
class BagOfWords:
    """Tokens within ``w`` places of either end of the target; all of them without ``w``.

    A single word has both ends at one place. Between two far ends only the tokens near
    either end count, so the work per target is O(w) however long the arc is.
    """

    w: int | None = None

    def positions(self, n: Column, left: Column, right: Column) -> Column:
        """Candidate positions as an array; may include the target's own places."""
        if not self.w:
            return F.sequence(F.lit(0), n - 1)
        w = F.lit(self.w)
        low = F.greatest(left - w, F.lit(0))
        high = F.least(right + w, n - 1)
        return F.when(right - left <= 2 * w, F.sequence(low, high)).otherwise(
            F.concat(F.sequence(low, left + w), F.sequence(right - w, high))
        )

    def positions_after(self, n: Column, left: Column) -> Column:
        """The part of a single word's window from its own place on."""
        return F.sequence(left, F.least(left + self.w, n - 1) if self.w else n - 1)

    def marker(self, position: Column, left: Column, right: Column) -> Column:
        return F.when(position < left, "l").when(position > right, "r").otherwise("c")


def can_halve(matchers: Sequence[Matcher], features: FeatureExtractor, same_format: bool) -> bool:
    """Whether single-word pairs come in both directions: every word is a target, the
    window reaches as far to the left as to the right, and both texts are made alike."""
    every_word = any(isinstance(m, Unigrams) for m in matchers)
    return every_word and isinstance(features, BagOfWords) and same_format


def key_columns(sentences: DataFrame) -> list[str]:
    return [c for c in other_columns(sentences) if c not in NOT_KEYS]


def all_matches(matchers: Sequence[Matcher]) -> Column:
    """The matches of all matchers, the same positions once."""
    found = [m.matches(TOKENS) for m in matchers]
    if len(found) == 1:
        return found[0]
    # sorting makes equal ones neighbours, so long sentences stay cheap
    return let(
        F.sort_array(F.concat(*found)),
        lambda ms: F.filter(ms, lambda m, i: (i == 0) | (F.get(ms, i - 1) != m)),
    )


def extract_pairs(
    sentences: DataFrame,
    matchers: Sequence[Matcher],
    features: FeatureExtractor = BagOfWords(),
    *,
    target_format: str = DEFAULT_FORMAT,
    context_format: str = DEFAULT_FORMAT,
    token_sep: str = DEFAULT_TOKEN_SEP,
    targets: Words = None,
    first: Words = None,
    second: Words = None,
    contexts: Words = None,
    halves: bool = False,
    long_chunks: bool = False,
) -> DataFrame:
    """(target, context) pairs of every sentence, one row per pair of positions.

    A target of several tokens has the window of its first and last place; its own places
    are no contexts. Tokens whose text is null, as they lack a field of the template, are
    neither targets nor contexts (see :func:`tokens_without_text`).

    ``targets`` lists single-word targets, ``first`` and ``second`` the first two words of
    longer targets, ``contexts`` the context words (an empty context list filters nothing, an
    empty target list rejects all). The same positions found by several matchers count once.
    Matching and windows stay inside the sentence row, so nothing is shuffled there; lists
    meet the slim pair rows, never the sentence arrays.

    With ``halves``, two words that are in each other's window give one row instead of
    two; its column ``mirrored`` says that it also stands for the pair with target and
    context exchanged. See :func:`can_halve` and ``count_pairs``.

    With ``long_chunks``, for whole texts as chunks, a target takes along the words of its window instead of
    those of its chunk, and runs of targets are dealt out, so a chunk's windows and counts are the
    work of many tasks. The rows are the same.
    """
    if halves and not can_halve(matchers, features, target_format == context_format):
        raise ValueError("these pairs cannot be halved")
    if not matchers:
        raise ValueError("at least one matcher is needed")

    keys = key_columns(sentences)
    tokens = TOKENS
    target_texts = format_tokens(tokens, target_format)
    same_format = target_format == context_format
    listed = dict(targets=targets, first=first, second=second, contexts=contexts)
    if long_chunks and not (isinstance(features, BagOfWords) and not features.w):
        context_texts = target_texts if same_format else format_tokens(tokens, context_format)
        pairs = pairs_of_long_chunks(sentences, matchers, features, target_texts, context_texts, token_sep, halves)
        return keep_listed_pairs(pairs, F.size("t_positions") == 1, **listed)
    single_words = all(isinstance(m, Unigrams) for m in matchers)
    carried = [*keys, "_t", *([] if same_format else ["_c"]), *(["_halved"] if halves else [])]
    found = prepared(sentences, matchers).select(
        *keys,
        target_texts.alias("_t"),
        *([] if same_format else [format_tokens(tokens, context_format).alias("_c")]),
        *([all_distinct(tokens["id"]).alias("_halved")] if halves else []),
        all_matches(matchers).alias("_m"),
    )
    # Names of targets are made in the sentence row. After it, rows of targets and of pairs pass through operators
    # without lambdas, which Spark fuses into one loop; it writes out each row before a lambda.
    if not single_words:
        found = found.withColumn("_m", F.transform("_m", lambda p: F.struct(p.alias("p"), name_of(p, F.col("_t"), token_sep).alias("name"))))
    opened = found.select(*carried, F.explode_outer("_m").alias("_x"))
    places = F.col("_x") if single_words else F.col("_x.p")
    opened = opened.where("_x IS NOT NULL").select(*carried, places.alias("_p"), *([] if single_words else ["_x.name"]))
    targets_df = opened.withColumns({"first": F.get("_t", F.get("_p", F.lit(0))), "second": F.get("_t", F.get("_p", F.lit(1)))})
    is_single = F.lit(True) if single_words else F.size("_p") == 1
    targets_df = targets_df.withColumns(
        # written out once per target, not once per pair
        {
            "target": F.col("first") if single_words else F.col("name"),
            "_l": F.array_min("_p"),
            "_r": F.array_max("_p"),
        }
    )

    context_texts = "_t" if same_format else "_c"
    n = F.size(context_texts)
    positions = features.positions(n, F.col("_l"), F.col("_r"))
    if halves:
        mirrored = F.col("_halved") & is_single
        positions = F.when(mirrored, features.positions_after(n, F.col("_l"))).otherwise(positions)
    place = F.col("c_position")
    own = (place == F.col("_l")) | (place == F.col("_r"))
    own = own | ((F.size("_p") > 2) & F.array_contains("_p", place))
    pairs = (
        targets_df.withColumn("c_position", F.explode_outer(F.when(F.col("target").isNotNull(), positions)))
        .where(~own & F.get(context_texts, "c_position").isNotNull())
        .select(
            *keys,
            "target",
            F.get(context_texts, "c_position").alias("context"),
            features.marker(place, F.col("_l"), F.col("_r")).alias("marker"),
            F.col("_p").alias("t_positions"),
            "c_position",
            "first",
            "second",
            *([mirrored.alias("mirrored")] if halves else []),
        )
    )
    return keep_listed_pairs(pairs, F.size("t_positions") == 1, **listed)


def name_of(p: Column, texts: Column, token_sep: str) -> Column:
    """The texts of a target's tokens as one; null where a text is missing."""
    first, second = F.get(texts, F.get(p, F.lit(0))), F.get(texts, F.get(p, F.lit(1)))
    words = F.transform(p, lambda i: F.get(texts, i))
    composed = F.when(F.forall(words, lambda w: w.isNotNull()), F.array_join(words, token_sep))
    # most targets have a word or two, which need no array of words
    return F.when(F.size(p) == 1, first).when(F.size(p) == 2, F.concat(first, F.lit(token_sep), second)).otherwise(composed)


def pairs_of_long_chunks(
    sentences: DataFrame,
    matchers: Sequence[Matcher],
    features: FeatureExtractor,
    target_texts: Column,
    context_texts: Column,
    token_sep: str,
    halves: bool,
) -> DataFrame:
    """The pairs of :func:`extract_pairs`, without lists, for chunks of many tokens."""
    keys = key_columns(sentences)

    def target_of(p: Column, t: Column, c: Column, halved: Column | None) -> Column:
        left, right, n = F.array_min(p), F.array_max(p), F.size(c)
        words = F.transform(p, lambda i: F.get(t, i))
        single = F.size(p) == 1
        composed = F.when(F.forall(words, lambda w: w.isNotNull()), F.array_join(words, token_sep))
        places = features.positions(n, left, right)
        mirrored = []
        if halved is not None:
            mirrored = [(halved & single).alias("mirrored")]
            places = F.when(halved & single, features.positions_after(n, left)).otherwise(places)
        near = F.filter(places, lambda i: ~F.array_contains(p, i) & F.get(c, i).isNotNull())
        near = F.transform(
            near, lambda i: F.struct(i.alias("c_position"), F.get(c, i).alias("context"), features.marker(i, left, right).alias("marker"))
        )
        return F.struct(
            F.when(single, F.get(words, F.lit(0))).otherwise(composed).alias("target"),
            p.alias("t_positions"),
            F.get(words, F.lit(0)).alias("first"),
            F.get(words, F.lit(1)).alias("second"),
            near.alias("near"),
            *mirrored,
        )

    def found(t: Column, c: Column, halved: Column | None) -> Column:
        of_all = F.transform(all_matches(matchers), lambda p: target_of(p, t, c, halved))
        of_all = F.filter(of_all, lambda m: m["target"].isNotNull())
        starts = lambda ms: F.sequence(F.lit(0), F.greatest(F.size(ms) - 1, F.lit(0)), F.lit(TOGETHER))
        return let(of_all, lambda ms: F.transform(starts(ms), lambda start: F.slice(ms, start + 1, F.lit(TOGETHER))))

    def bound(halved: Column | None) -> Column:
        return let(target_texts, lambda t: let(context_texts, lambda c: found(t, c, halved)))

    blocks = let(all_distinct(TOKENS["id"]), bound) if halves else bound(None)
    dealt = (
        prepared(sentences, matchers)
        .select(*keys, F.explode_outer(blocks).alias("_b"))
        .where("_b IS NOT NULL")
        .repartition(F.xxhash64(*keys, "_b"))
    )
    targets = dealt.select(*keys, F.explode_outer("_b").alias("_m")).where("_m IS NOT NULL").select(*keys, "_m.*")
    named = [c for c in targets.columns if c not in ("near", *keys)]
    pairs = targets.select(*keys, *named, F.explode_outer("near").alias("_n")).where("_n IS NOT NULL")
    columns = ["target", "_n.context", "_n.marker", "t_positions", "_n.c_position", "first", "second"]
    return pairs.select(*keys, *columns, *(["mirrored"] if halves else []))


def keep_listed_pairs(
    pairs: DataFrame, is_single: Column, targets: Words, first: Words, second: Words, contexts: Words
) -> DataFrame:
    """The list tests of :func:`extract_pairs`, on pairs or on counts of pairs."""
    for column, words, applies in (
        ("first", targets, is_single),
        ("first", first, ~is_single),
        ("second", second, ~is_single),
        ("context", contexts, None),
    ):
        listed = word_table(pairs.sparkSession, words)
        if listed is not None:
            pairs = keep_listed(pairs, F.col(column), listed, applies, empty_keeps_all=column == "context")
    return pairs


def tokens_without_text(sentences: DataFrame, template: str = DEFAULT_FORMAT) -> DataFrame:
    """``keys, positions`` of tokens that lack a field of the template and so form no pairs."""
    texts = format_tokens(TOKENS, template)
    places = F.filter(F.transform(texts, lambda t, i: F.when(t.isNull(), i)), lambda i: i.isNotNull())
    rows = sentences.select(*key_columns(sentences), places.alias("positions"))
    return where_here(rows, F.size("positions") > 0)


def match_rows(sentences: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """One row per match: positions and their texts, same positions once."""
    keys = key_columns(sentences)
    texts = format_tokens(TOKENS, DEFAULT_FORMAT)
    return (
        prepared(sentences, matchers)
        .select(*keys, texts.alias("_t"), all_matches(matchers).alias("_m"))
        .select(*keys, "_t", F.explode_outer("_m").alias("positions"))
        .where("positions IS NOT NULL")
        .withColumn("words", F.transform("positions", lambda p: F.get("_t", p)))
        .drop("_t")
    )
