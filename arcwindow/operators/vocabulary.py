"""Words as list indices, and back.

``encode`` and ``decode`` translate a column of any table. :func:`encoded_tokens` translates the tokens of a corpus
before pairs are made, so pairs are counted as two indices packed into one long
(:func:`packed_counts`), and only the sums are read back. Indices are below 2^31.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import all_distinct, let
from arcwindow.functions.tokens import DEFAULT_FORMAT, TOKENS, by_id, format_tokens
from arcwindow.operators.filters import SALTS, joined_to_words

def index_of_words(words: DataFrame, id_column: str) -> DataFrame:
    """``word`` and its list index, the last one of equal entries; ``words`` has ``word, id`` as from ``read_words``."""
    return words.groupBy("word").agg(F.max("id").alias(id_column))


def encode(df: DataFrame, column: str, words: DataFrame, id_column: str) -> DataFrame:
    """Add the list index of a text column: the last of equal entries, null if not listed."""
    joined = joined_to_words(df, F.col(column), index_of_words(words, id_column), "left")
    return joined.select(*df.columns, id_column)


def decode(df: DataFrame, id_column: str, words: DataFrame, column: str) -> DataFrame:
    """Add the list entry an index stands for; frequent indices are salted."""
    entries = words.select(
        F.col("id").alias("_id"), F.col("word").alias(column), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_at")
    )
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    same = (F.col(id_column) == F.col("_id")) & (F.col("_salt") == F.col("_at"))
    return salted.join(entries, same, "left").select(*df.columns, column)


def encoded_tokens(sentences: DataFrame, words: DataFrame, key: list[str], template: str = DEFAULT_FORMAT) -> DataFrame:
    """``key, coded``: a row for each sentence with listed tokens, ``coded`` an array of ``place, id, is_target``.

    Places are those among all tokens, in order. With repeated ids only the last token of each is a target,
    as for :class:`Unigrams`. Tokens meet the list once, frequent ones salted.
    """
    last_of_id = by_id(TOKENS.rows("id", "sentence_pos"))["sentence_pos"]
    every = all_distinct(TOKENS["id"])
    rows = let(
        F.when(~every, F.array_sort(last_of_id)),
        lambda targets: F.transform(
            format_tokens(TOKENS, template),
            lambda t, i: F.struct(t.alias("text"), i.alias("place"), (targets.isNull() | F.array_contains(targets, i)).alias("is_target")),
        ),
    )
    tokens = sentences.select(*key, F.explode_outer(rows).alias("_t")).select(*key, "_t.*")
    listed = joined_to_words(tokens, F.col("text"), index_of_words(words, "id"), "inner")
    coded = F.sort_array(F.collect_list(F.struct("place", "id", "is_target")))
    return listed.groupBy(*key).agg(coded.alias("coded"))


def packed_counts(coded: DataFrame, w: int) -> DataFrame:
    """``pivot_id, context_id, occurrences`` of listed tokens within ``w`` places of each other, from :func:`encoded_tokens`.

    Two tokens give one row, whichever of them are targets; their indices are one long with two sums.
    """
    if w < 1:
        raise ValueError("the window has one place at least")

    def after(t: Column, i: Column, all_: Column) -> Column:
        # at most w listed tokens follow within w places
        near = F.filter(F.slice(all_, i + 2, F.lit(w)), lambda c: (c["place"] <= t["place"] + w) & (t["is_target"] | c["is_target"]))
        return F.transform(near, lambda c: pair(t, c))

    def pair(t: Column, c: Column) -> Column:
        ahead = t["id"] <= c["id"]
        low, high = F.least(t["id"], c["id"]), F.greatest(t["id"], c["id"])
        return F.struct(
            F.shiftleft(low, 32).bitwiseOR(high).alias("packed"),
            F.when(ahead, t["is_target"]).otherwise(c["is_target"]).cast("bigint").alias("low_first"),
            F.when(ahead, c["is_target"]).otherwise(t["is_target"]).cast("bigint").alias("high_first"),
        )

    pairs = let(F.col("coded"), lambda all_: F.flatten(F.transform(all_, lambda t, i: after(t, i, all_))))
    sums = (
        coded.select(F.explode_outer(pairs).alias("p"))
        .where("p IS NOT NULL")
        .groupBy("p.packed")
        .agg(F.sum("p.low_first").alias("low_first"), F.sum("p.high_first").alias("high_first"))
    )
    low, high = F.shiftright("packed", 32), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1))
    same = low == high
    both = F.array(
        F.struct(
            low.alias("pivot_id"),
            high.alias("context_id"),
            F.when(same, F.col("low_first") + F.col("high_first")).otherwise(F.col("low_first")).alias("occurrences"),
        ),
        F.struct(high.alias("pivot_id"), low.alias("context_id"), F.when(same, 0).otherwise(F.col("high_first")).alias("occurrences")),
    )
    return sums.select(F.inline(both)).where("occurrences > 0")


def decode_counts(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``pivot, context`` to ``pivot_id, context_id, occurrences``."""
    return decode(decode(counts, "pivot_id", words, "pivot"), "context_id", words, "context")
