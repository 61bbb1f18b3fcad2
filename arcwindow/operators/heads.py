"""Noun heads: move the head of a noun to the last word of a predicate chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import let
from arcwindow.functions.tokens import (
    LINE_FIELDS,
    PREFIX,
    TOKEN_COLUMNS,
    TOKENS,
    other_columns,
)
from arcwindow.operators.trim import replace_fields

# Tags of predicate words, and relations that end a chain.
PREDICATE_TAG = "^(JJ|MD|V)"
CHAIN_END_RELATION = "^(PRN|OBJ|ADV|COORD|AMOD)"


def contentful_noun_heads(sentences: DataFrame) -> DataFrame:
    """Rewrite ``dep_id`` of nouns that depend on a predicate to their right.

    A predicate word (adjective, modal, verb) points to the last later predicate word
    that depends on it by a relation that does not end the chain; a noun whose head is to
    its right is moved along these pointers to the end. All other fields stay.
    ``rewritten`` is false for sentences that pass unchanged because their ids are not
    1..n or a noun points outside.
    """
    others = other_columns(sentences)

    def described(t: Column) -> Column:
        has_text = (t["word"] != "") & (t["lemma"] != "")
        predicate = (
            (t["n_fields"] == len(LINE_FIELDS))
            & has_text
            & t["pos"].rlike(PREDICATE_TAG)
            & (t["dep_rel"] != "")
        )
        noun = (t["n_fields"] >= 5) & has_text & t["pos"].rlike("^N.")
        return F.struct(
            t["id"].try_cast("int").alias("i"),
            t["dep_id"].try_cast("int").alias("h"),
            F.coalesce(predicate, F.lit(False)).alias("predicate"),
            F.coalesce(noun, F.lit(False)).alias("noun"),
            F.coalesce(t["dep_rel"].rlike(CHAIN_END_RELATION), F.lit(True)).alias("ends"),
        )

    words = F.transform(TOKENS.rows(*LINE_FIELDS, "n_fields"), described)

    def links(ws: Column) -> Column:
        """(head, dependent) pairs of neighbouring chain members."""
        linked = F.filter(
            ws,
            lambda w: w["predicate"]
            & ~w["ends"]
            & (w["h"] > 0)
            & (w["h"] < w["i"])
            & F.coalesce(F.get(ws, w["h"] - 1)["predicate"], F.lit(False)),
        )
        return F.transform(linked, lambda w: F.struct(w["h"].alias("h"), w["i"].alias("i")))

    def chain_ends(ws: Column, pairs: Column) -> Column:
        """For each place, where its chain ends: pointers are followed in doubled steps."""

        def between(first: Column, last: Column) -> Column:
            return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        def with_gaps(last_of: Column) -> Column:
            """The last dependent of each head, and of all places between them themselves."""
            before = lambda k: F.coalesce(F.get(last_of, k - 1)["h"], F.lit(0))
            pieces = F.transform(
                last_of, lambda p, k: F.concat(between(before(k) + 1, p["h"] - 1), F.array(p["i"]))
            )
            return F.concat(F.flatten(pieces), between(before(F.size(last_of)) + 1, F.size(ws)))

        def last_of_each(ordered: Column) -> Column:
            return F.filter(ordered, lambda p, k: ~(F.get(ordered, k + 1)["h"].eqNullSafe(p["h"])))

        pointers = let(F.array_sort(pairs), lambda ordered: let(last_of_each(ordered), with_gaps))
        steps = F.ceil(F.log2(F.size(pairs) + F.lit(1))).cast("int") + 1
        return F.aggregate(
            F.sequence(F.lit(1), steps),
            pointers,
            lambda p, _: F.transform(p, lambda target: F.get(p, target - 1)),
        )

    def new_heads(ws: Column) -> Column:
        """Array of heads, or null when the sentence must pass unchanged."""
        moves = lambda w: w["noun"] & (w["h"] > w["i"])
        regular = (F.transform(ws, lambda _, k: k + 1) == ws["i"]) & ~F.exists(
            ws, lambda w: F.coalesce(moves(w) & (w["h"] > F.size(ws)), F.lit(False))
        )

        def rewritten(pairs: Column) -> Column:
            moved = let(
                chain_ends(ws, pairs),
                lambda ends: F.transform(
                    ws, lambda w: F.when(moves(w), F.get(ends, w["h"] - 1)).otherwise(w["h"])
                ),
            )
            return F.when(F.size(pairs) > 0, moved).otherwise(ws["h"])

        return F.when(regular, let(links(ws), rewritten))

    heads = sentences.select(*others, *TOKEN_COLUMNS, let(words, new_heads).alias("_heads"))
    dep_ids = F.zip_with(
        TOKENS["dep_id"],
        F.col("_heads"),
        lambda old, new: F.when(old.try_cast("int") == new, old).otherwise(
            F.coalesce(new.cast("string"), old)
        ),
    )
    changed = {
        "dep_id": F.when(F.col("_heads").isNull(), TOKENS["dep_id"]).otherwise(dep_ids),
        # a line that cannot be rebuilt from its fields is changed in its place
        "line": F.when(
            F.col("_heads").isNull() | TOKENS.is_regular, F.col(PREFIX + "line")
        ).otherwise(
            F.zip_with(
                F.col(PREFIX + "line"), dep_ids, lambda line, head: replace_fields(line, {4: head})
            )
        ),
    }
    return heads.select(
        *others,
        *[changed.get(c.removeprefix(PREFIX), F.col(c)).alias(c) for c in TOKEN_COLUMNS],
        F.col("_heads").isNotNull().alias("rewritten"),
    )
