"""Sentence search: keep sentences with a match and mark the matched tokens."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import where_here
from arcwindow.functions.tokens import (
    STORED,
    TOKEN_COLUMNS,
    TOKENS,
    Tokens,
    by_id,
    other_columns,
    token_arrays,
)
from arcwindow.operators.matchers import Matcher, prepared


def matched_positions(matchers: Sequence[Matcher], tokens: Tokens) -> list[Column]:
    """Per matcher, the distinct positions its matches cover."""
    return [F.array_distinct(F.flatten(m.matches(tokens))) for m in matchers]


def grep(sentences: DataFrame, matchers: Sequence[Matcher], intersect: bool = False) -> DataFrame:
    """Sentences with at least one match; ``tok_is_match`` flags their tokens (by id).

    ``matched`` lists the positions any matcher covers. With ``intersect`` some position
    must be covered by all matchers; what is marked stays the union. No shuffle.
    """
    if not matchers:
        raise ValueError("at least one matcher is needed")
    others = other_columns(sentences)
    names = [f"_m{i}" for i in range(len(matchers))]
    found = matched_positions(matchers, TOKENS)
    df = prepared(sentences, matchers)
    df = df.select(*others, *TOKEN_COLUMNS, *[c.alias(n) for c, n in zip(found, names)])
    union = F.array_sort(F.array_distinct(F.concat(*names)))
    common = functools.reduce(F.array_intersect, [F.col(n) for n in names])
    df = df.select(*others, *TOKEN_COLUMNS, union.alias("matched"), common.alias("_common"))
    kept = where_here(df, F.size("_common" if intersect else "matched") > 0)
    flags = F.transform(TOKENS["id"], lambda _, i: F.array_contains(F.col("matched"), i))
    rows = by_id(TOKENS.rows(*STORED, is_match=flags))
    printed = kept.select(*others, "matched", *TOKEN_COLUMNS[-2:], rows.alias("_rows"))
    return printed.select(
        *others, *token_arrays("_rows"), F.col("_rows")["is_match"].alias("tok_is_match"), "matched"
    )
