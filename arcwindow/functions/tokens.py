"""Token columns of a sentence row, and text templates over them.

A sentence is one row with parallel arrays, one per token field (``tok_word``,
``tok_lemma`` …): a query reads, parses and stores just the fields it names.
``tok_line`` holds the raw lines where they cannot be rebuilt from the six fields, and
``tok_n_fields`` the field counts where one is not six; both are null for the usual
sentence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from arcwindow.functions.arrays import all_distinct, index_of, let

# Column order of a corpus line, default template and separator.
LINE_FIELDS = ("word", "lemma", "pos", "id", "dep_id", "dep_rel")
DEFAULT_FORMAT = "{lemma}-{cat}"
DEFAULT_TOKEN_SEP = "<-->"

MIN_FIELDS = 4  # word, lemma, pos and id must be there for a token to exist
STORED = (*LINE_FIELDS, "line", "n_fields")
PREFIX = "tok_"
TOKEN_COLUMNS = tuple(PREFIX + name for name in STORED)


def category(pos: Column) -> Column:
    """Coarse category: the first character of the tag, lowered."""
    return F.lower(F.substring(pos, 1, 1))


class Tokens:
    """The token arrays of the current row: ``tokens["lemma"]`` is ``array<string>``."""

    def __getitem__(self, name: str) -> Column:
        if name == "cat":
            return F.transform(self["pos"], category)
        if name == "sentence_pos":
            return index_of(self["id"])
        if name == "line":
            return F.coalesce(F.col(PREFIX + "line"), self.fields_lines())
        if name == "n_fields":
            six = F.transform(self["id"], lambda _: F.lit(len(LINE_FIELDS)))
            return F.coalesce(F.col(PREFIX + "n_fields"), six)
        if name not in STORED:
            raise KeyError(name)
        return F.col(PREFIX + name)

    def rows(self, *names: str, **arrays: Column) -> Column:
        """``array<struct>`` of the named fields and further arrays of the same length."""
        columns = [self[n].alias(n) for n in names]
        columns += [array.alias(name) for name, array in arrays.items()]
        return F.arrays_zip(*columns)

    def fields_lines(self) -> Column:
        """The six fields of each token, joined by tabs."""
        return F.transform(
            self.rows(*LINE_FIELDS), lambda t: F.concat_ws("\t", *[t[f] for f in LINE_FIELDS])
        )

    @property
    def is_regular(self) -> Column:
        """Whether the lines are just their six fields."""
        return F.col(PREFIX + "line").isNull()


TOKENS = Tokens()


def other_columns(sentences: DataFrame) -> list[str]:
    """All columns of a sentence table but the token arrays."""
    return [c for c in sentences.columns if not c.startswith(PREFIX)]


def token_arrays(rows: str, keep_null: bool = True) -> list[Column]:
    """The token columns out of an ``array<struct>`` column with all stored fields.

    Lines and field counts stay null where they were null before.
    """
    columns = []
    for name in STORED:
        values = F.col(rows)[name]
        if keep_null and name in ("line", "n_fields"):
            values = F.when(F.col(PREFIX + name).isNotNull(), values)
        columns.append(values.alias(PREFIX + name))
    return columns


def rewrite_tokens(
    sentences: DataFrame, rewrite: Callable[[Column], Column], extra: tuple[str, ...] = ()
) -> DataFrame:
    """Replace the tokens of each sentence by what ``rewrite`` makes of their structs.

    ``rewrite`` takes and returns ``array<struct>`` with all stored fields. Only for
    operators that change tokens; readers of tokens use the arrays.
    """
    others = other_columns(sentences)
    none = F.transform(TOKENS["id"], lambda _: F.lit(None).cast("string"))
    no_count = F.transform(TOKENS["id"], lambda _: F.lit(len(LINE_FIELDS)))
    rows = TOKENS.rows(
        *LINE_FIELDS,
        line=F.coalesce(F.col(PREFIX + "line"), none),
        n_fields=F.coalesce(F.col(PREFIX + "n_fields"), no_count),
    )
    changed = sentences.select(
        *others, *TOKEN_COLUMNS[len(LINE_FIELDS):], *extra, rewrite(rows).alias("_rows")
    )
    return changed.select(*others, *token_arrays("_rows"), *extra)


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """``(literal text, field name or None)`` pairs; plain field names only."""
    allowed = (*LINE_FIELDS, "cat", "sentence_pos")
    parts = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if name is not None and (name not in allowed or spec or conversion):
            raise ValueError(f"template may name only {allowed}, without format specs: {template!r}")
        parts.append((literal, name))
    return parts


def format_tokens(tokens: Tokens, template: str = DEFAULT_FORMAT) -> Column:
    """Fill a template for every token of a sentence: ``array<string>``."""
    parts = template_parts(template)
    names = list(dict.fromkeys(name for _, name in parts if name))
    if not names:
        return F.transform(tokens["id"], lambda _: F.lit(template.format()))
    if template == f"{{{names[0]}}}":
        values = tokens[names[0]]
        return values.cast("array<string>") if names[0] == "sentence_pos" else values

    def filled(value: Callable[[str], Column]) -> Column:
        pieces = []
        for literal, name in parts:
            if literal:
                pieces.append(F.lit(literal))
            if name:
                pieces.append(value(name))
        return F.concat(*pieces)

    def field(row: Column, i: Column, name: str) -> Column:
        if name == "cat":
            return category(row["pos"])
        return i.cast("string") if name == "sentence_pos" else row[name]

    needed = ["pos" if n == "cat" else "id" if n == "sentence_pos" else n for n in names]
    needed = list(dict.fromkeys(needed))
    if len(needed) == 1:
        only = needed[0]
        return F.transform(tokens[only], lambda v, i: filled(lambda n: field({only: v}, i, n)))
    if len(needed) == 2 and "sentence_pos" not in names:
        a, b = needed
        return F.zip_with(
            tokens[a], tokens[b], lambda x, y: filled(lambda n: field({a: x, b: y}, F.lit(0), n))
        )
    return F.transform(tokens.rows(*needed), lambda r, i: filled(lambda n: field(r, i, n)))


def by_id(rows: Column) -> Column:
    """Tokens de-duplicated by id: the last one wins, at the place of the first.

    ``rows`` is ``array<struct>`` with a field ``id``. Ids repeat only when a chunk
    spans several sentences; the usual sentence is returned as it is.
    """

    def dedupe(all_rows: Column) -> Column:
        keyed = F.transform(all_rows, lambda t, i: F.struct(t["id"].alias("id"), i.alias("i")))

        def pick_last(ordered: Column) -> Column:
            firsts = F.filter(
                ordered, lambda t, i: (i == 0) | (F.get(ordered, i - 1)["id"] != t["id"])
            )
            lasts = F.filter(
                ordered,
                lambda t, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["id"] != t["id"]),
            )
            spans = F.zip_with(
                firsts, lasts, lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last"))
            )
            return F.transform(F.sort_array(spans), lambda s: F.get(all_rows, s["last"]))

        return let(F.sort_array(keyed), pick_last)

    return let(rows, lambda rs: F.when(all_distinct(rs["id"]), rs).otherwise(dedupe(rs)))


def both(flags: list[Column]) -> Column | None:
    """Element-wise AND of boolean arrays; None when there is nothing to test."""
    if not flags:
        return None
    return functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x & y), flags)
