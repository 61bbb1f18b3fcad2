"""The operators once more in plain Python over lists, to compare small cases with."""

from __future__ import annotations

import re
from collections import Counter

FIELDS = ("word", "lemma", "pos", "id", "dep_id", "dep_rel")


def read(text: str, separator: str = "s", to_lower: bool = False) -> list[list[dict]]:
    """Sentences of one file."""
    sentences, current = [], []
    for line in text.split("\n"):
        if line.strip("<>") == "/" + separator:
            sentences.append(current)
            current = []
        elif line and not (line.startswith("<") and line.endswith(">")):
            token = dict(zip(FIELDS, line.split("\t")))
            token["line"] = line
            if to_lower:
                token["word"], token["lemma"] = token["word"].lower(), token["lemma"].lower()
            current.append(token)
    return sentences


def text_of(token: dict, template: str = "{lemma}-{cat}") -> str:
    return template.format(cat=token["pos"][0].lower(), **token)


def unigrams(sentence: list[dict]) -> list[tuple[int, ...]]:
    last = {t["id"]: i for i, t in enumerate(sentence)}
    return [(i,) for i in last.values()]


def arcs(sentence, relation=None, dependent=lambda t: True, head=lambda t: True):
    last = {t["id"]: i for i, t in enumerate(sentence)}
    found = []
    for i in last.values():
        t = sentence[i]
        if t["dep_id"] == "0" or not dependent(t) or (relation and not re.match(relation, t["dep_rel"])):
            continue
        h = last.get(t["dep_id"])
        if h is not None and head(sentence[h]):
            found.append((i, h))
    return found


def contexts(n: int, match: tuple[int, ...], w: int | None) -> list[tuple[int, str]]:
    left, right = min(match), max(match)
    found = []
    for p in range(n):
        if p in match:
            continue
        if w and min(abs(p - left), abs(p - right)) > w:
            continue
        found.append((p, "l" if p < left else "r" if p > right else "c"))
    return found


def count(sentences, matchers, w=None, fmt="{lemma}-{cat}", sep="<-->") -> Counter:
    total = Counter()
    for s in sentences:
        targets = {m for matcher in matchers for m in matcher(s)}
        for m in targets:
            pivot = sep.join(text_of(s[i], fmt) for i in m)
            for p, _ in contexts(len(s), m, w):
                total[pivot, text_of(s[p], fmt)] += 1
    return total


def trim(sentence: list[dict], keep) -> list[tuple[int, int]]:
    """New (id, head) of the kept tokens."""
    removed = [int(t["id"]) for t in sentence if not keep(t)]

    def shifted(v: int) -> int:
        return v - sum(r < v for r in removed)

    return [
        (shifted(int(t["id"])), -1 if int(t["dep_id"]) in removed else shifted(int(t["dep_id"])))
        for t in sentence
        if keep(t)
    ]


def noun_heads(sentence: list[dict]) -> list[int]:
    """New heads, for ids 1..n."""
    heads = [int(t["dep_id"]) for t in sentence]
    predicate = [bool(re.match("JJ|MD|V", t["pos"])) for t in sentence]
    follow = {}
    for i, t in enumerate(sentence, 1):
        h = heads[i - 1]
        ends = re.match("PRN|OBJ|ADV|COORD|AMOD", t["dep_rel"])
        if predicate[i - 1] and 0 < h < i and predicate[h - 1] and not ends:
            follow[h] = i
    new = []
    for i, t in enumerate(sentence, 1):
        h = heads[i - 1]
        if re.match("N.", t["pos"]) and h > i:
            while h in follow:
                h = follow[h]
        new.append(h)
    return new


def parts(texts: list[int], n_sentences: int) -> list[int]:
    """Part of each text, given the sentences of each."""
    part, since, found = 1, 0, []
    for n in texts:
        found.append(part)
        since += n
        if since >= n_sentences:
            part, since = part + 1, 0
    return found


def corpus(sentences: list[list[dict]]) -> str:
    lines = []
    for s in sentences:
        lines += ["<s>", *["\t".join(t[f] for f in FIELDS) for t in s], "</s>"]
    return "".join(l + "\n" for l in lines)
