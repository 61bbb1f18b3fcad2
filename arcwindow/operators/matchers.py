"""Matchers pick targets in a sentence.

A matcher is any object with ``matches(tokens)``: it takes the token arrays of the row and
returns ``array<array<int>>``, one array of sentence positions per match. The order of
positions inside a match counts: (dependent, head) is not (head, dependent).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions import automaton, linear
from arcwindow.functions.arrays import all_distinct, let
from arcwindow.functions.predicates import TokenTest, prefix_match
from arcwindow.functions.tokens import TOKENS, Tokens, by_id

ROOT_ID = "0"  # fixed value: the dep_id of a root token


@runtime_checkable
class Matcher(Protocol):
    def matches(self, tokens: Tokens) -> Column: ...


def prepared(sentences: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """Let matchers add columns that they read, if they have a method ``prepare(sentences)``."""
    for m in matchers:
        if hasattr(m, "prepare"):
            sentences = m.prepare(sentences)
    return sentences


@dataclass(frozen=True)
class Unigrams:
    """Every token of the sentence (the last one of each id)."""

    def matches(self, tokens: Tokens) -> Column:
        last_of_id = F.transform(
            by_id(tokens.rows("id", "sentence_pos")), lambda t: F.array(t["sentence_pos"])
        )
        every = F.transform(tokens["id"], lambda _, i: F.array(i))
        return F.when(all_distinct(tokens["id"]), every).otherwise(last_of_id)


@dataclass(frozen=True)
class LinearPhrases:
    """Runs of tokens that match a phrase pattern; see :mod:`arcwindow.functions.linear`."""

    pattern: str
    ignore_case: bool = False
    lists: Mapping[str, Iterable[str]] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "_parsed", linear.parse_pattern(self.pattern, self.lists))
        object.__setattr__(self, "_column", f"_spans_{uuid.uuid4().hex}")

    def prepare(self, sentences: DataFrame) -> DataFrame:
        """Add the column that ``matches`` reads where it cannot be an expression."""
        if not self._parsed.recursive or self._parsed.automaton:
            return sentences
        text = linear.symbols(TOKENS, self._parsed, self.ignore_case)
        return linear.with_spans(sentences, text, self._parsed, self._column)

    def matches(self, tokens: Tokens) -> Column:
        if self._parsed.automaton:
            places = linear.places(tokens, self._parsed, self.ignore_case)
            spans = automaton.spans(places, self._parsed.automaton)
        elif self._parsed.recursive:
            spans = F.col(self._column)
        else:
            spans = linear.spans(linear.symbols(tokens, self._parsed, self.ignore_case), self._parsed.regex)
        return F.transform(spans, lambda s: F.sequence(s["start"], s["stop"] - 1))


@dataclass(frozen=True)
class DependencyArcs:
    """(dependent, head) pairs whose ends pass their tests and whose relation fits.

    ``relation`` is a case-sensitive prefix pattern. Roots have no head; an arc to an
    id that is not in the sentence is no match.
    """

    relation: str | None = None
    dependent: TokenTest = TokenTest()
    head: TokenTest = TokenTest()

    def matches(self, tokens: Tokens) -> Column:
        flags = {}
        for name, test in (("dep_ok", self.dependent), ("head_ok", self.head)):
            array = test.flags(tokens)
            if array is not None:
                flags[name] = array
        fields = ["sentence_pos", "id", "dep_id"] + (["dep_rel"] if self.relation else [])
        nodes = by_id(tokens.rows(*fields, **flags))

        def is_dependent(t: Column) -> Column:
            ok = t["dep_id"] != ROOT_ID
            if "dep_ok" in flags:
                ok = ok & t["dep_ok"]
            if self.relation:
                ok = ok & prefix_match(t["dep_rel"], self.relation, ignore_case=False)
            return F.coalesce(ok, F.lit(False))

        def arcs(rows: Column, ids: Column) -> Column:
            def head_of(t: Column) -> Column:
                # ids are nearly always 1..n, so look there first and search if not
                guess = t["dep_id"].try_cast("int") - 1
                at_guess = F.when(F.get(ids, guess) == t["dep_id"], guess)
                found = F.array_position(ids, t["dep_id"]).cast("int") - 1
                return F.get(rows, F.coalesce(at_guess, found))

            pairs = F.transform(
                F.filter(rows, is_dependent),
                lambda t: F.struct(t["sentence_pos"].alias("dep"), head_of(t).alias("head")),
            )
            kept = F.filter(
                pairs,
                lambda p: p["head"].isNotNull()
                & (p["head"]["head_ok"] if "head_ok" in flags else F.lit(True)),
            )
            return F.transform(kept, lambda p: F.array(p["dep"], p["head"]["sentence_pos"]))

        return let(nodes, lambda rows: let(rows["id"], lambda ids: arcs(rows, ids)))


def composition_matchers(
    linear_pattern: str | None = None,
    ignore_case: bool = False,
    lists: Mapping[str, Iterable[str]] | None = None,
    relation: str | None = None,
    dependent: TokenTest = TokenTest(),
    head: TokenTest = TokenTest(),
) -> list[Matcher]:
    """The phrase matchers a set of options asks for: phrases, arcs, both or none."""
    found: list[Matcher] = []
    if linear_pattern:
        found.append(LinearPhrases(linear_pattern, ignore_case, lists or {}))
    if relation or not dependent.is_empty or not head.is_empty:
        found.append(DependencyArcs(relation, dependent, head))
    return found
