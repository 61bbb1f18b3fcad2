"""Word lists as filters.

A list is a table that is joined, whatever its size; Spark chooses the strategy from the size it
measures, and nothing is broadcast by hint. Only flags of tokens are looked up in tasks where the list is short. Frequent words are salted, so a word that
makes up a third of the rows is spread over several tasks also where the list is not broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcwindow.functions.arrays import let
from arcwindow.functions.tokens import DEFAULT_FORMAT, TOKENS, format_tokens
from arcwindow.plans.scratch import DENSE, cut_lineage

#: Over how many tasks the rows of one word are spread.
SALTS = 16

#: Texts times list entries of a sentence up to which each text is looked up by itself.
LOOKED_UP = 1 << 12

#: Bytes of a list up to which the tasks that flag tokens hold it.
TAKEN_BYTES = 64 << 20
#: Texts that are hashed at a time.
HASHED = 1 << 18

Words = DataFrame | Iterable[str] | None


def word_table(spark: SparkSession, words: Words) -> DataFrame | None:
    """The distinct entries of a list, as the column ``word``."""
    if words is None:
        return None
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    return words.select(F.col("word").cast("string")).where("word IS NOT NULL").distinct()


def joined_to_words(df: DataFrame, key: Column, words: DataFrame, how: str) -> DataFrame:
    """Join on ``key = words.word``, the words salted; other columns of ``words`` come along.

    Adds ``_word`` (null where ``how`` is left and nothing matches). Null keys match nothing
    and do not meet in one task either.
    """
    row = F.xxhash64(*df.columns)
    keyed = df.withColumns(
        {
            "_key": F.coalesce(key, F.concat(F.lit("\u0000"), row.cast("string"))),
            "_salt": F.pmod(row, F.lit(SALTS)),
        }
    )
    copies = words.select(
        F.col("word").alias("_word"),
        *[c for c in words.columns if c != "word"],
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("_at"),
    )
    same = (F.col("_key") == F.col("_word")) & (F.col("_salt") == F.col("_at"))
    return keyed.join(copies, same, how).drop("_key", "_salt", "_at")


def keep_listed(
    df: DataFrame,
    value: Column,
    words: DataFrame,
    applies: Column | None = None,
    empty_keeps_all: bool = False,
) -> DataFrame:
    """Rows whose ``value`` is in the list; rows to which the test does not apply stay.

    An empty list keeps nothing, or with ``empty_keeps_all`` everything; whether it is empty
    is found out when the job runs.
    """
    if applies is None and not empty_keeps_all:
        return joined_to_words(df, value, words, "inner").drop("_word")
    key = value if applies is None else F.when(applies, value)
    keep = F.col("_word").isNotNull()
    if applies is not None:
        keep = keep | ~F.coalesce(applies, F.lit(False))
    if empty_keeps_all:
        keep = keep | ~words.exists()
    return joined_to_words(df, key, words, "left").where(keep).drop("_word")


def flag_words(
    sentences: DataFrame,
    words: DataFrame,
    column: str,
    key: list[str],
    template: str = DEFAULT_FORMAT,
    texts: Column | None = None,
) -> DataFrame:
    """Add a boolean array saying which tokens are in a list.

    A list of up to ``TAKEN_BYTES`` is given to the tasks, which look up the texts of a batch of sentences: no shuffle and no
    table of sentences. Of a longer one only the words that occur count. With more than that the sentences are written to the shared folder, so they are parsed once, although
    they are read twice: only the texts of tokens meet the list, and what comes back per
    sentence is the array of matching texts. So a frequent word crosses the shuffle once per
    sentence and not once per token, and it is salted. Use the result through
    ``TokenTest(flag_column=column)`` or, with ``texts=raw_field(TOKENS, "word")``, as
    ``Flagged(column)`` list of a phrase pattern. ``key`` must identify a sentence; ``texts``
    replaces the template.
    """
    spark = sentences.sparkSession
    listed = cut_lineage(word_table(spark, words))
    of_token = format_tokens(TOKENS, template) if texts is None else texts
    if not taken(listed):
        occurring = sentences.select(F.explode_outer(F.array_distinct(of_token)).alias("word")).distinct()
        listed = cut_lineage(listed.join(occurring, "word", "left_semi"))
    if taken(listed):
        return sentences.withColumn(column, looked_up(spark, listed)(of_token))
    sentences = cut_lineage(sentences, DENSE)
    texts = sentences.select(*key, F.explode_outer(F.array_distinct(of_token)).alias("_text"))
    found = joined_to_words(texts, F.col("_text"), listed, "inner")
    hits = found.groupBy(*key).agg(F.collect_set("_text").alias("_hits"))
    return sentences.join(hits, key, "left").withColumn(column, marked(of_token, F.col("_hits"))).drop("_hits")


def taken(listed: DataFrame) -> bool:
    """Whether a list is short enough for tasks to hold it."""
    return (listed.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= TAKEN_BYTES


def looked_up(spark: SparkSession, listed: DataFrame) -> Callable[[Column], Column]:
    """A function of arrays of texts that says which are in the list; null texts are not."""
    # workers need not be able to import this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    words = listed.toArrow()["word"].combine_chunks()
    hashes = text_hashes(words)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], words.take(pa.array(order))))
    return F.arrow_udf(lambda texts: in_list(texts, *sent.value), "array<boolean>")


def text_hashes(texts: pa.Array) -> np.ndarray:
    """Hashes by which texts are found; they are compared as well."""
    found = [np.zeros(0, np.uint64)]
    for first in range(0, len(texts), HASHED):
        part = np.array(texts.slice(first, HASHED).to_pylist(), dtype=object)
        found.append(pd.util.hash_array(part, categorize=False))
    return np.concatenate(found)


def in_list(texts: pa.Array, hashes: np.ndarray, words: pa.Array) -> pa.Array:
    """For arrays of texts, which are among ``words``, in the order of their hashes."""
    coded = pc.dictionary_encode(texts.flatten())
    wanted = text_hashes(coded.dictionary)
    known = np.zeros(len(wanted), dtype=bool)
    at, left = np.searchsorted(hashes, wanted), np.arange(len(wanted))
    while len(left):  # again only where several words have one hash
        left = left[at[left] < len(hashes)]
        left = left[hashes[at[left]] == wanted[left]]
        known[left] = pc.equal(words.take(pa.array(at[left])), coded.dictionary.take(pa.array(left))).to_numpy(zero_copy_only=False)
        left = left[~known[left]]
        at[left] += 1
    found = pc.fill_null(pa.array(known, pa.bool_()).take(coded.indices), False)
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, found, mask=pc.is_null(texts))


def marked(texts: Column, hits: Column) -> Column:
    """Which texts are among ``hits``, one boolean each; ``hits`` may be null.

    Few texts are looked up one by one. Where a sentence is long its texts are sorted together with the hits, so that
    the work grows with the sentence and not with its square.
    """

    def one_by_one(ts: Column, hs: Column) -> Column:
        return F.transform(ts, lambda t: F.coalesce(F.array_contains(hs, t), F.lit(False)))

    def by_sorting(ts: Column, hs: Column) -> Column:
        # a hit stands before all places of its text
        places = F.transform(ts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        heads = F.transform(hs, lambda h: F.struct(h.alias("t"), F.lit(-1).alias("i")))
        found = let(
            F.sort_array(F.concat(heads, places)),
            lambda all_: let(
                F.filter(F.transform(all_, lambda x, k: F.when(x["i"] < 0, k)), lambda k: k.isNotNull()),
                lambda at: F.flatten(
                    F.transform(
                        at,
                        # what follows a hit up to the next one, as far as it is the same text
                        lambda k, j: F.transform(
                            F.filter(
                                F.slice(all_, k + 2, F.coalesce(F.get(at, j + 1), F.size(all_)) - k - 1),
                                lambda x: x["t"] == F.get(all_, k)["t"],
                            ),
                            lambda x: x["i"],
                        ),
                    )
                ),
            ),
        )
        # the places that were found, in order, against all places
        return let(F.sort_array(found), lambda places_: flags_at(places_, F.size(ts)))

    def flags_at(places_: Column, n: Column) -> Column:
        """``n`` booleans of which those at sorted places are true."""
        ends = F.concat(places_, F.array(n))
        runs = let(
            ends,
            lambda es: F.transform(
                es,
                lambda e, k: F.concat(
                    F.array_repeat(F.lit(False), e - F.when(k > 0, F.get(es, k - 1)).otherwise(F.lit(-1)) - 1),
                    F.array_repeat(F.lit(True), F.when(e < n, 1).otherwise(0)),
                ),
            ),
        )
        return F.flatten(runs)

    def choose(ts: Column, hs: Column) -> Column:
        return F.when(F.size(ts).cast("bigint") * F.size(hs) <= LOOKED_UP, one_by_one(ts, hs)).otherwise(by_sorting(ts, hs))

    none = F.array().cast("array<string>")
    return let(texts, lambda ts: let(F.coalesce(hits, none), lambda hs: choose(ts, hs)))
