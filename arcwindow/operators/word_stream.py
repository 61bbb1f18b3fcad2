"""Word stream: one ``word-p`` line per lexical token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.predicates import is_lexical
from arcwindow.functions.tokens import TOKENS, category
from arcwindow.operators.windows import key_columns

SENTENCE_OPEN = "<s>"  # fixed value
WHOLE_TAG = "VVG"  # fixed value: tags with this text are shown whole


def word_with_category(lemma: Column, pos: Column) -> Column:
    """``lemma-p``: p is the coarse category, or the whole tag lowered for ``VVG``."""
    shown = F.when(pos.contains(WHOLE_TAG), F.lower(pos)).otherwise(category(pos))
    return F.concat_ws("-", lemma, shown)


def word_stream(sentences: DataFrame) -> DataFrame:
    """``keys, place, line``: a ``<s>`` line per sentence, then its lexical words."""
    keys = key_columns(sentences)
    lexical = F.filter(TOKENS.rows("lemma", "pos"), lambda t: is_lexical(t["lemma"], t["pos"]))
    words = F.transform(lexical, lambda t: word_with_category(t["lemma"], t["pos"]))
    opening = F.array(F.lit(SENTENCE_OPEN))
    if "text_open" in sentences.columns:
        opening = F.filter("text_open", lambda l: l == SENTENCE_OPEN)
    lines = sentences.select(*keys, F.posexplode_outer(F.concat(opening, words)).alias("place", "line"))
    return lines.where("line IS NOT NULL")
