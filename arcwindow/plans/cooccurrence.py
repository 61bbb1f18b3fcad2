"""The three usual jobs: corpus → pairs, corpus → counts, corpus → matching sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.predicates import is_content
from arcwindow.functions.tokens import DEFAULT_FORMAT, DEFAULT_TOKEN_SEP, TOKEN_COLUMNS, TOKENS
from arcwindow.operators.counting import (
    count_pairs,
    filter_counts,
    whole_sentence_counts,
    whole_sentence_match_counts,
    with_space,
)
from arcwindow.operators.filters import Words
from arcwindow.operators.matchers import Matcher, Unigrams
from arcwindow.operators.windows import (
    BagOfWords,
    FeatureExtractor,
    can_halve,
    extract_pairs,
    keep_listed_pairs,
)


def only_content(sentences: DataFrame) -> DataFrame:
    """Leave out all but nouns, adjectives, verbs and adverbs, before windows are taken.

    Each field is filtered by itself, so those that nobody asks for are not made.
    """

    def kept(name: str) -> Column:
        rows = F.filter(F.arrays_zip(F.col(name).alias("v"), TOKENS["pos"].alias("p")), lambda t: is_content(t["p"]))
        return F.transform(rows, lambda t: t["v"])

    return sentences.withColumns({c: kept(c) for c in TOKEN_COLUMNS if c in sentences.columns})


def cooccurrence_counts(
    sentences: DataFrame,
    *,
    window: int | None = None,
    unigrams: bool = True,
    compositions: Sequence[Matcher] = (),
    features: FeatureExtractor | None = None,
    content_only: bool = False,
    target_format: str = DEFAULT_FORMAT,
    context_format: str = DEFAULT_FORMAT,
    token_sep: str = DEFAULT_TOKEN_SEP,
    targets: Words = None,
    first: Words = None,
    second: Words = None,
    contexts: Words = None,
    rows: Words = None,
    cols: Words = None,
    long_chunks: bool = False,
) -> DataFrame:
    """Core and peripheral counts of a corpus in one pass and one shuffle.

    With the whole sentence as window, pairs are counted from the targets and words of
    each sentence, without listing them. ``long_chunks`` is for whole texts as
    chunks (:func:`extract_pairs`): their targets are dealt out by a shuffle of their own.
    """
    if content_only:
        sentences = only_content(sentences)
    if unigrams and not compositions and not window and features is None:
        counts = whole_sentence_counts(
            sentences,
            target_format=target_format,
            context_format=context_format,
            targets=targets,
            contexts=contexts,
            token_sep=token_sep,
        )
        return filter_counts(counts, token_sep=token_sep, rows=rows, cols=cols)
    matchers = ([Unigrams()] if unigrams else []) + list(compositions)
    features = features or BagOfWords(window)
    lists = dict(targets=targets, first=first, second=second, contexts=contexts)
    unlisted = all(words is None for words in lists.values())
    if unlisted and isinstance(features, BagOfWords) and not features.w:
        formats = dict(target_format=target_format, context_format=context_format, token_sep=token_sep)
        counts = whole_sentence_match_counts(sentences, matchers, **formats)
        return filter_counts(counts, token_sep=token_sep, rows=rows, cols=cols)
    # the first word of a single-word target is the target: lists of targets then meet counts in both directions
    single_words = all(isinstance(m, Unigrams) for m in matchers)
    pairs = extract_pairs(
        sentences,
        matchers,
        features,
        target_format=target_format,
        context_format=context_format,
        token_sep=token_sep,
        halves=(unlisted or single_words) and can_halve(matchers, features, target_format == context_format),
        long_chunks=long_chunks,
    )
    if unlisted:
        return count_pairs(pairs, token_sep=token_sep, rows=rows, cols=cols)
    if single_words:
        counts = count_pairs(pairs, token_sep=token_sep).withColumns({"first": F.col("pivot"), "second": F.lit(None).cast("string")})
        counts = keep_listed_pairs(counts, F.lit(True), **lists).drop("first", "second")
        return filter_counts(counts, token_sep=token_sep, rows=rows, cols=cols)

    # Lists meet counts, where each pair is one row, and not pairs.
    single = (F.size("t_positions") == 1).alias("_single")
    counts = pairs.groupBy(F.col("target").alias("pivot"), "first", "second", "context", single).agg(
        F.count("*").alias("occurrences")
    )
    counts = keep_listed_pairs(counts, F.col("_single"), **lists)
    counts = counts.groupBy("pivot", "context").agg(F.sum("occurrences").alias("occurrences"))
    return filter_counts(with_space(counts, token_sep), token_sep=token_sep, rows=rows, cols=cols)
