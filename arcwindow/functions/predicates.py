"""Token predicates: prefix regular expressions and word lists."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from arcwindow.functions.tokens import DEFAULT_FORMAT, Tokens, both, category, format_tokens

# First tag letters of content words.
CONTENT_TAG_LETTERS = ("N", "J", "V", "R")
# The tag and word patterns of a lexical token.
LEXICAL_TAG = "^(NN|VV|RB|JJ)"
LEXICAL_WORD = "^[A-Za-z]([A-Za-z-]*[A-Za-z])?$"


def prefix_regex(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern that is anchored at the start only.

    ``(?d)`` makes a line feed the only line end, ``(?i)`` folds ASCII letters.
    """
    return ("(?i)" if ignore_case else "") + rf"(?d)\A(?:{pattern})"


def prefix_match(value: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(value.rlike(prefix_regex(pattern, ignore_case)), F.lit(False))


def is_content(pos: Column) -> Column:
    """Noun, adjective, verb or adverb, by the first letter of the tag."""
    return F.upper(category(pos)).isin(*CONTENT_TAG_LETTERS)


def is_lexical(lemma: Column, pos: Column) -> Column:
    """Open-class tag, and a word of letters with single inner hyphens."""
    return pos.rlike(LEXICAL_TAG) & lemma.rlike(LEXICAL_WORD) & ~lemma.contains("--")


@dataclass(frozen=True)
class TokenTest:
    """A conjunction of tests on one token; with no test every token passes.

    ``word``, ``lemma`` and ``pos`` are case-insensitive prefix patterns; ``words`` is
    a list of texts in ``words_format``. ``flag_column`` names a boolean array column
    that already holds the list test, for lists too long to be part of the plan (see
    :func:`arcwindow.operators.filters.flag_words`).
    """

    word: str | None = None
    lemma: str | None = None
    pos: str | None = None
    words: Iterable[str] | None = None
    words_format: str = DEFAULT_FORMAT
    flag_column: str | None = None

    @property
    def is_empty(self) -> bool:
        return not (self.word or self.lemma or self.pos or self.flag_column) and self.words is None

    def flags(self, tokens: Tokens) -> Column | None:
        """One boolean per token, or None when everything passes."""

        def matching(values: Column, pattern: str) -> Column:
            return F.transform(values, lambda v: prefix_match(v, pattern))

        tests = [
            matching(tokens[name], pattern)
            for name, pattern in (("word", self.word), ("lemma", self.lemma), ("pos", self.pos))
            if pattern
        ]
        if self.words is not None:
            texts = format_tokens(tokens, self.words_format)
            entries = sorted(set(self.words))
            tests.append(
                F.transform(texts, lambda t: F.coalesce(t.isin(entries), F.lit(False)))
            )
        if self.flag_column:
            tests.append(F.col(self.flag_column))
        return both(tests)
