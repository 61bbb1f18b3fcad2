"""Dependency graphs: edges as rows, and one DOT text per sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import let
from arcwindow.functions.tokens import LINE_FIELDS, TOKENS
from arcwindow.operators.order import row_numbers
from arcwindow.operators.windows import key_columns
from arcwindow.plans.scratch import DENSE


def dep_edges(sentences: DataFrame) -> DataFrame:
    """``keys, id, dep_id, dep_rel, label``: one edge from each token to its head."""
    keys = key_columns(sentences)
    rows = TOKENS.rows("id", "dep_id", "dep_rel", "word", "pos")
    t = sentences.select(*keys, F.explode_outer(rows).alias("t")).where("t IS NOT NULL")
    return t.select(*keys, "t.id", "t.dep_id", "t.dep_rel", F.concat_ws("/", "t.word", "t.pos").alias("label"))


# The lines of a DOT graph.
GRAPH_OPEN = "digraph sentence_%d {"
NODE = 'n_%s[label="%s/%s"];'
ARC = 'n_%s -> n_%s [label="%s"];'
LABEL = 'label = "%s"'
GRAPH_CLOSE = "}"


def dot_graphs(sentences: DataFrame, order: list[str]) -> DataFrame:
    """``order, number, dot``: sentences numbered from 0 along ``order``.

    ``order`` must identify a sentence. A sentence with a token of other than six fields
    keeps its number and has no graph.
    """
    six: Column = F.forall(TOKENS["n_fields"], lambda n: n == len(LINE_FIELDS))
    # sentences are numbered as one text of their fields; the far longer graph is made last
    held = sentences.select(*order, F.when(six, packed_tokens()).alias("_t"))
    numbered = row_numbers(held, order, "_n", DENSE).select(*order, "_n", F.col("_t").isNotNull().alias("_six"), unpacked("_t").alias("_rows"))
    lines = F.flatten(
        F.transform(
            "_rows",
            lambda t: F.array(
                F.format_string(NODE, t["id"], t["word"], t["pos"]),
                F.format_string(ARC, t["id"], t["dep_id"], t["dep_rel"]),
            ),
        )
    )
    words = F.array_join(F.transform("_rows", lambda t: t["word"]), " ")
    number = F.col("_n") - 1
    opening, label = F.format_string(GRAPH_OPEN, number), F.format_string(LABEL, F.trim(words))
    body = F.concat(F.array(opening), lines, F.array(label, F.lit(GRAPH_CLOSE)))
    return numbered.select(*order, number.alias("number"), F.when(F.col("_six"), F.array_join(body, "\n")).alias("dot"))


#: The fields of a graph.
GRAPH_FIELDS = ("id", "word", "pos", "dep_id", "dep_rel")


def packed_tokens() -> Column:
    """The graph's fields of a sentence as ``text``, a line each and field by field, or as ``rows`` where one is null or holds a line end."""
    fields = F.flatten(F.array(*[TOKENS[name] for name in GRAPH_FIELDS]))

    def pack(values: Column) -> Column:
        text = F.array_join(values, "\n")
        odd = F.exists(values, lambda v: v.isNull() | v.contains("\n")) | (F.size(values) == 0)
        rows = TOKENS.rows(*GRAPH_FIELDS)
        return F.struct(F.when(~odd, text).alias("text"), F.when(odd, rows).alias("rows"))

    return let(fields, pack)


def unpacked(column: str) -> Column:
    """The rows of a packed sentence."""

    def unpack(parts: Column) -> Column:
        n = F.floor(F.size(parts) / len(GRAPH_FIELDS)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(*[F.get(parts, n * k + i).alias(name) for k, name in enumerate(GRAPH_FIELDS)]),
        )

    text = F.col(column)["text"]
    return F.when(text.isNull(), F.col(column)["rows"]).otherwise(let(F.split(text, "\n", -1), unpack))
