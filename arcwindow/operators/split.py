"""Split a corpus into parts at text ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwindow.operators.order import running_totals
from arcwindow.plans.scratch import DENSE, cut_lineage


def split_by_texts(pieces: DataFrame, order: list[str], n_texts: int = 1) -> DataFrame:
    """Add ``part`` (from 1): a new part begins after every ``n_texts`` text ends.

    ``pieces`` are stretches of corpus in the order of ``order``, with ``ends_text`` true
    where a piece closes a text.
    """
    if n_texts < 1:
        raise ValueError("a part has at least one text")
    numbered = _with_text_numbers(pieces, order)
    part = F.floor((F.col("text_no") - 1) / n_texts) + 1
    return numbered.select(*pieces.columns, part.cast("bigint").alias("part"))


def split_by_sentences(pieces: DataFrame, order: list[str], n_sentences: int) -> DataFrame:
    """Add ``part`` (from 1): cut at the first text end with ``n_sentences`` since the last cut.

    Where the next cut falls depends on the last one. For each text that could begin a
    part, the text that ends it is found from running totals; the cuts really made are
    those reached from the first text. They are followed in steps that grow fourfold, so
    the number of rounds is logarithmic in the number of parts, each a few joins on text
    numbers. All this is done without the texts of the pieces, which are read again and cut at the
    places that were found.
    """
    if n_sentences < 1:
        raise ValueError("a part has at least one sentence")
    numbered = _with_text_numbers(pieces.select(*order, "n_sentences", "ends_text"), order)

    # Each text end stands on one line with the total that a part beginning after it asks
    # for; the number of ends before that total tells which text reaches it first.
    start = F.struct(F.lit(n_sentences).cast("bigint").alias("at"), F.lit(0).alias("is_end"), F.lit(1).cast("bigint").alias("text_no"))
    marks = numbered.where("ends_text").select(
        F.explode(
            F.array(
                F.struct(F.col("_upto").alias("at"), F.lit(1).alias("is_end"), "text_no"),
                F.struct(
                    (F.col("_upto") + n_sentences).alias("at"),
                    F.lit(0).alias("is_end"),
                    (F.col("text_no") + 1).alias("text_no"),
                ),
            )
        ).alias("m")
    )
    spark = pieces.sparkSession
    marks = marks.unionByName(spark.range(1).select(start.alias("m"))).select("m.*")
    line = running_totals(marks, ["at", "is_end", "text_no"], {"passed": F.col("is_end")})
    # a part that starts at text_no ends with text passed + 1, the next one starts after it
    jumps = line.where("is_end = 0").select(
        F.col("text_no").alias("start"), (F.col("passed") + 2).alias("next")
    )
    size = line.agg(F.sum("is_end").alias("texts"), F.max(F.when(F.col("is_end") == 1, F.col("at"))).alias("sentences")).first()
    texts = size["texts"] or 0
    jumps = cut_lineage(jumps.where(F.col("next") <= texts + 1))
    most_parts = min(texts, (size["sentences"] or 0) // n_sentences) + 1

    starts = spark.range(1, 2, 1, 1).select(F.col("id").alias("start"))
    step = 1
    while step < most_parts:
        twice = _compose(jumps, jumps)
        starts = starts.unionByName(_follow(starts, jumps))
        starts = cut_lineage(starts.unionByName(_follow(starts, twice)))
        step *= 4
        if step < most_parts:
            jumps = cut_lineage(_compose(twice, twice))

    # the part of a piece is the number of starts up to it
    firsts = numbered.groupBy("text_no").agg(F.min(F.struct(*order)).alias("_at"))
    rows = pieces.select(F.struct(*order).alias("_at"), F.lit(1).alias("_kind"), F.struct(*pieces.columns).alias("_row"))
    cuts = firsts.join(starts.withColumnRenamed("start", "text_no"), "text_no").select(
        "_at", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    )
    counted = running_totals(rows.unionByName(cuts), ["_at", "_kind"], {"part": 1 - F.col("_kind")}, DENSE)
    return counted.where("_kind = 1").select("_row.*", "part")


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Jumps that make one step after another."""
    after = then.select(F.col("start").alias("next"), F.col("next").alias("_after"))
    return first.join(after, "next").select("start", F.col("_after").alias("next"))


def _follow(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """Where the jumps lead from the given starts; always onwards, so to other starts."""
    return starts.join(jumps, "start").select(F.col("next").alias("start"))


def _with_text_numbers(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Add the number of the text a piece belongs to (one more than the text ends before
    it) and the number of sentences up to and with the piece."""
    ends = F.col("ends_text").cast("int")
    wanted = {"_ended": ends}
    if "n_sentences" in pieces.columns:
        wanted["_upto"] = F.col("n_sentences")
    totals = running_totals(pieces, order, wanted, DENSE)
    return totals.withColumn("text_no", F.col("_ended") - ends + 1).drop("_ended")
