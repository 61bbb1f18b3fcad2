"""Counting pairs into core and peripheral co-occurrence tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import all_distinct, let, run_lengths
from arcwindow.functions.tokens import DEFAULT_FORMAT, DEFAULT_TOKEN_SEP, TOKENS, by_id, format_tokens
from arcwindow.operators.filters import Words, keep_listed, word_table
from arcwindow.operators.matchers import Matcher, prepared
from arcwindow.operators.windows import all_matches, key_columns
from arcwindow.plans.scratch import passing_table

CORE, PERIPHERAL = "core", "peripheral"  # fixed values: names of the two spaces

#: Pairs of whole sentences that are counted in a round: for each word of a sentence, and at least.
PAIRS_EACH = 1
LEAST_PAIRS = 1 << 23


def space_of(pivot: Column, token_sep: str = DEFAULT_TOKEN_SEP) -> Column:
    """Composed pivots live in the peripheral space, single words in the core."""
    return F.when(pivot.contains(token_sep), PERIPHERAL).otherwise(CORE)


def second_part(pivot: Column, token_sep: str = DEFAULT_TOKEN_SEP) -> Column:
    """The second word of a composed pivot; null for a single word."""
    return F.get(F.split(pivot, r"\Q" + token_sep + r"\E", -1), F.lit(1))


def count_pairs(
    pairs: DataFrame,
    *,
    token_sep: str = DEFAULT_TOKEN_SEP,
    rows: Words = None,
    cols: Words = None,
) -> DataFrame:
    """Counts per (pivot, context): ``space, pivot, context, occurrences``.

    Partial aggregation runs before the one shuffle, so a pair that makes up a third of
    the input crosses it once per task. ``rows`` tests the pivot, or the second word of a
    composed one; ``cols`` tests the context; an empty list filters nothing. Lists are joined
    to the counts, where each pair is one row.
    """
    mirrored = ["mirrored"] if "mirrored" in pairs.columns else []
    slim = pairs.select(F.col("target").alias("pivot"), "context", *mirrored)
    if mirrored:
        counts = _sum_both_ways(slim, F.lit(1).cast("bigint"), F.col("mirrored"))
    else:
        counts = slim.groupBy("pivot", "context").agg(F.count("*").alias("occurrences"))
    return with_space(filter_counts(counts, token_sep=token_sep, rows=rows, cols=cols), token_sep)


def _sum_both_ways(pairs: DataFrame, n: Column, mirrored: Column) -> DataFrame:
    """Sum ``pivot, context`` rows, of which mirrored ones count in both directions.

    Both directions of a pair share one group with two sums, so what is aggregated and
    shuffled is about half; they part again afterwards, without another shuffle.
    """
    ahead = F.col("pivot") <= F.col("context")
    sums = (
        pairs.select(
            F.least("pivot", "context").alias("_a"),
            F.greatest("pivot", "context").alias("_b"),
            F.when(mirrored | ahead, n).otherwise(0).alias("_ab"),
            F.when(mirrored | ~ahead, n).otherwise(0).alias("_ba"),
        )
        .groupBy("_a", "_b")
        .agg(F.sum("_ab").alias("_ab"), F.sum("_ba").alias("_ba"))
    )
    same = F.col("_a") == F.col("_b")
    both = F.array(
        F.struct(
            F.col("_a").alias("pivot"),
            F.col("_b").alias("context"),
            F.when(same, F.col("_ab") + F.col("_ba")).otherwise(F.col("_ab")).alias("occurrences"),
        ),
        F.struct(
            F.col("_b").alias("pivot"),
            F.col("_a").alias("context"),
            F.when(same, 0).otherwise(F.col("_ba")).alias("occurrences"),
        ),
    )
    return sums.select(F.inline(both)).where("occurrences > 0")


def filter_counts(
    counts: DataFrame,
    *,
    token_sep: str = DEFAULT_TOKEN_SEP,
    rows: Words = None,
    cols: Words = None,
) -> DataFrame:
    """The row and column filters of :func:`count_pairs`, on finished counts."""
    pivot = F.coalesce(second_part(F.col("pivot"), token_sep), F.col("pivot"))
    for value, words in ((pivot, rows), (F.col("context"), cols)):
        listed = word_table(counts.sparkSession, words)
        if listed is not None:
            counts = keep_listed(counts, value, listed, empty_keeps_all=True)
    return counts


def with_space(counts: DataFrame, token_sep: str = DEFAULT_TOKEN_SEP) -> DataFrame:
    return counts.select(
        space_of(F.col("pivot"), token_sep).alias("space"), "pivot", "context", "occurrences"
    )


def merge_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add counts to earlier counts: one row per (space, pivot, context)."""
    columns = ["space", "pivot", "context", "occurrences"]
    return sum_counts(stored.select(*columns).unionByName(new.select(*columns)))


def sum_counts(counts: DataFrame) -> DataFrame:
    """One row per (space, pivot, context) of counts in which keys may repeat."""
    return counts.groupBy("space", "pivot", "context").agg(F.sum("occurrences").alias("occurrences"))


def sentence_hash(sentences: DataFrame) -> Column:
    """What sentences are dealt out by: their keys, so that equal sentences do not meet in one task."""
    return F.xxhash64(*(key_columns(sentences) or [TOKENS["lemma"]]))


def dealt_blocks(rows: DataFrame, block: int, *by: Column) -> DataFrame:
    """``_t`` in blocks that are dealt out by ``_key`` or ``by``, and ``_start`` of each; rows without targets are left out."""
    starts = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1, F.lit(block)))
    blocks = rows.select("*", F.explode_outer(starts).alias("_start")).where("_start IS NOT NULL")
    return blocks.withColumn("_t", F.slice("_t", F.col("_start") + 1, F.lit(block))).repartition(*(by or ("_key", "_start")))


def whole_sentence_counts(
    sentences: DataFrame,
    *,
    target_format: str = DEFAULT_FORMAT,
    context_format: str = DEFAULT_FORMAT,
    targets: Words = None,
    contexts: Words = None,
    token_sep: str = DEFAULT_TOKEN_SEP,
    block: int = 512,
) -> DataFrame:
    """Single-word counts with the whole sentence as window, without listing all pairs.

    Of n_t targets and n_c contexts of a sentence, all n_t·n_c combinations are pairs but
    those of a token with itself. So each sentence gives one row per pair of distinct
    words with a weight. Only for single-word targets; with repeated ids, targets are the
    last token of each id, as for :class:`Unigrams`.

    The distinct targets of each sentence are cut into blocks that are spread over the
    cluster before pairing: one shuffle of the word counts (much less than of the pairs),
    so that a few chunks that hold much of the data, such as whole texts, are no task each.
    Lists meet the counts.
    """
    symmetric = target_format == context_format
    runs = _dealt_runs(sentences, target_format, context_format, block)
    weighted = _weighted_pairs(runs, symmetric, block)
    if symmetric:
        counts = _sum_both_ways(weighted, F.col("n"), F.col("mirrored"))
    else:
        own = sentences.select(F.explode_outer(_targets(target_format, context_format)).alias("p"))
        own = own.where("p.t IS NOT NULL AND p.c IS NOT NULL").select(
            F.col("p.t").alias("pivot"),
            F.col("p.c").alias("context"),
            F.lit(-1).cast("bigint").alias("n"),
            F.lit(False).alias("mirrored"),
        )
        counts = (
            weighted.unionByName(own)
            .groupBy("pivot", "context")
            .agg(F.sum("n").alias("occurrences"))
            .where("occurrences > 0")
        )
    for column, words in (("pivot", targets), ("context", contexts)):
        listed = word_table(sentences.sparkSession, words)
        if listed is not None:
            counts = keep_listed(counts, F.col(column), listed, empty_keeps_all=column == "context")
    return with_space(counts, token_sep)


def _targets(target_format: str, context_format: str) -> Column:
    """One struct per target: its text as target, and its own text as context."""
    return by_id(TOKENS.rows("id", t=format_tokens(TOKENS, target_format), c=format_tokens(TOKENS, context_format)))


def _dealt_runs(sentences: DataFrame, target_format: str, context_format: str, block: int) -> DataFrame:
    """``_c, _t, _unique, _start``: the words of each sentence and a block of its targets, counted, dealt out.

    ``_t`` is null where it is what ``_c`` holds from ``_start`` on.
    """
    symmetric = target_format == context_format
    unique = all_distinct(TOKENS["id"])
    last = _targets(target_format, context_format)["t"]
    t_text = F.when(unique, format_tokens(TOKENS, target_format)).otherwise(last)
    runs = sentences.select(
        run_lengths(format_tokens(TOKENS, context_format)).alias("_c"),
        *([] if symmetric else [run_lengths(t_text).alias("_t")]),
        *([F.when(~unique, last).alias("_last")] if symmetric else []),
        unique.alias("_unique"),
    )
    if symmetric:  # targets are counted apart only where ids repeat
        runs = runs.select("_c", "_unique", F.when(~F.col("_unique"), run_lengths(F.col("_last"))).alias("_t"))
    n = F.size(F.coalesce("_t", "_c"))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block)))
    blocks = runs.select("*", F.explode_outer(starts).alias("_start")).where("_start IS NOT NULL")
    blocks = blocks.withColumn("_t", F.slice("_t", F.col("_start") + 1, F.lit(block)))
    # equal sentences meet, so that their pairs are added up before they are shuffled
    return blocks.repartition(F.xxhash64(_targets_of_block(block)))


def _targets_of_block(block: int) -> Column:
    return F.coalesce("_t", F.slice("_c", F.col("_start") + 1, F.lit(block)))


def _weighted_pairs(runs: DataFrame, symmetric: bool, block: int, share: tuple[int, int] | None = None) -> DataFrame:
    """``pivot, context, n, mirrored``: the pairs of distinct words of each sentence.

    With ``share`` (k, n), only those pairs whose lesser word is of the k-th of n shares of all words; pairs in
    both directions are of one share.
    """

    def shared(word: Column) -> Column:
        return F.lit(True) if share is None else F.pmod(F.xxhash64(word), F.lit(share[1])) == share[0]

    t_run = F.posexplode_outer(_targets_of_block(block)).alias("_i", "t")
    opened = runs.select("_c", "_unique", "_start", t_run).withColumn("_i", F.col("_i") + F.col("_start"))
    opened = opened.where("t IS NOT NULL")

    # With targets and contexts alike, the words of a sentence are one sorted list: each
    # word is paired with itself and those after it, and such a pair counts both ways.
    halved = F.col("_unique") if symmetric else F.lit(False)
    if share is not None:
        opened = opened.where(~halved | shared(F.col("t.value")))
    first = F.when(halved, F.col("_i")).otherwise(F.lit(0))
    reach = F.when(F.size("_c") > 0, F.sequence(first, F.size("_c") - 1))
    paired = (
        opened.select("_c", "t", halved.alias("_halved"), F.explode_outer(reach).alias("_j"))
        .where("_j IS NOT NULL")
        .select("t", F.get("_c", "_j").alias("c"), "_halved")
    )
    if share is not None:
        paired = paired.where(F.col("_halved") | shared(F.least("t.value", "c.value")))
    alike = F.col("t.value") == F.col("c.value")
    weight = F.col("t.n") * F.col("c.n")
    if symmetric:
        weight = weight - F.when(alike, F.col("t.n")).otherwise(0)
    return paired.select(
        F.col("t.value").alias("pivot"),
        F.col("c.value").alias("context"),
        weight.alias("n"),
        # a word with itself is complete in one direction
        (F.col("_halved") & ~alike).alias("mirrored"),
    )


def whole_sentence_rounds(
    sentences: DataFrame, *, template: str = DEFAULT_FORMAT, token_sep: str = DEFAULT_TOKEN_SEP, block: int = 512
) -> Iterator[DataFrame]:
    """The rows of :func:`whole_sentence_counts` in tables that share no pair, targets and contexts alike.

    Pairs of whole sentences are many times the text. The words of sentences are counted once, and each round makes and
    shuffles the pairs of a share of the words only, so that what lies on disk at a time stays in proportion to the words
    (``PAIRS_EACH``). A round must be used up (written, or summed and written) before the next one is asked for.
    """
    with passing_table(_dealt_runs(sentences, template, template, block)) as runs:
        n_t, n_c = F.size(_targets_of_block(block)).cast("bigint"), F.size("_c")
        pairs = F.when(F.col("_unique"), n_t * (n_c - F.col("_start")) - n_t * (n_t - 1) / 2).otherwise(n_t * n_c)
        size = runs.agg(F.sum(pairs).alias("pairs"), F.sum(n_t).alias("words")).first()
        n = math.ceil((size["pairs"] or 0) / max(PAIRS_EACH * (size["words"] or 0), LEAST_PAIRS))
        for k in range(max(n, 1)):
            weighted = _weighted_pairs(runs, True, block, (k, n) if n > 1 else None)
            yield with_space(_sum_both_ways(weighted, F.col("n"), F.col("mirrored")), token_sep)


def whole_sentence_match_counts(
    sentences: DataFrame,
    matchers: Sequence[Matcher],
    *,
    target_format: str = DEFAULT_FORMAT,
    context_format: str = DEFAULT_FORMAT,
    token_sep: str = DEFAULT_TOKEN_SEP,
    block: int = 512,
) -> DataFrame:
    """Counts of targets of any length with the whole sentence as window, without listing all pairs.

    A target that occurs n times has n times the words of its sentence as contexts, less what stands at its
    own places. So each sentence gives a row per pair of distinct target and distinct word with a weight, and a row
    per own place that is taken off. Runs of targets are dealt out, so that long chunks are no task each.
    """
    c_text = format_tokens(TOKENS, context_format)
    t_text = format_tokens(TOKENS, target_format)

    def found(t: Column, c: Column) -> Column:
        def of_match(p: Column) -> Column:
            words = F.transform(p, lambda i: F.get(t, i))
            composed = F.when(F.forall(words, lambda w: w.isNotNull()), F.array_join(words, token_sep))
            target = F.when(F.size(p) == 1, F.get(words, F.lit(0))).otherwise(composed)
            own = F.filter(F.transform(F.array_distinct(p), lambda i: F.get(c, i)), lambda w: w.isNotNull())
            return F.struct(target.alias("target"), own.alias("own"))

        matches = F.filter(F.transform(all_matches(matchers), of_match), lambda m: m["target"].isNotNull())

        def entries(ms: Column) -> Column:
            runs = F.transform(run_lengths(ms["target"]), lambda r: entry(r["value"], r["n"], F.lit(None).cast("string")))
            off = F.transform(ms, lambda m: F.transform(m["own"], lambda w: entry(m["target"], F.lit(-1).cast("bigint"), w)))
            return F.concat(runs, F.flatten(off))

        return let(matches, entries)

    def entry(value: Column, n: Column, own: Column) -> Column:
        return F.struct(value.alias("value"), n.alias("n"), own.alias("own"))

    both = let(t_text, lambda t: found(t, t)) if target_format == context_format else let(t_text, lambda t: let(c_text, lambda c: found(t, c)))
    rows = prepared(sentences, matchers).select(sentence_hash(sentences).alias("_key"), c_text.alias("_w"), both.alias("_t"))
    rows = rows.select("_key", "_t", F.when(F.size("_t") > 0, run_lengths(F.col("_w"))).alias("_c"))
    dealt = dealt_blocks(rows, block)
    targets = dealt.select("_c", F.explode_outer("_t").alias("t")).where("t IS NOT NULL")
    taken_off = F.array(F.struct(F.col("t.own").alias("value"), F.lit(1).cast("bigint").alias("n")))
    contexts = F.when(F.col("t.own").isNull(), F.col("_c")).otherwise(taken_off)
    pairs = targets.select("t", F.explode_outer(contexts).alias("c")).where("c IS NOT NULL")
    counts = pairs.groupBy(F.col("t.value").alias("pivot"), F.col("c.value").alias("context")).agg(
        F.sum(F.col("t.n") * F.col("c.n")).alias("occurrences")
    )
    return with_space(counts.where("occurrences > 0"), token_sep)


def sort_counts(counts: DataFrame, by_value: bool = False, reverse: bool = False) -> DataFrame:
    """Counts ordered by key, or by value with ties by key; code-point order."""
    order = ["pivot", "context"] if not by_value else ["occurrences", "pivot", "context"]
    return counts.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in order])
