"""Plain-Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links) -> dict:
    """The smallest id that links reach, for every id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substring_dedup(texts: dict[int, str | None], length: int = 100) -> dict[int, tuple]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` by id."""
    seen, out = set(), {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            string = raw[at : at + length]
            if string in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(string)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the base spans, in order."""
    kinds = ("assign", "access", "hex")
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(s, e, kinds[k]) for s, k, e in sorted(found)]


def contamination(text: str | None, items: dict, n: int = 10) -> tuple[int, set[int], set]:
    """Number of words, words that are hit, items that occur."""
    words, hit, named = LETTERED.findall(lowered(text)), set(), set()
    for item, item_text in items.items():
        own = LETTERED.findall(lowered(item_text))
        width = min(n, len(own))
        windows = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else set()
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in windows:
                hit |= set(range(i, i + width))
                named.add(item)
    return len(words), hit, named


def shingles(text: str | None, width: int) -> frozenset:
    words = SPACED.findall(lowered(text))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard_links(texts: dict[int, str | None], width: int = 4, percent: int = 85) -> list[tuple[int, int]]:
    sets = {i: shingles(t, width) for i, t in texts.items()}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    links = []
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in by_shingle[x]:
                if j < i:
                    shared[j] += 1
        links += [(i, j) for j, both in shared.items() if 100 * both >= percent * (len(s) + len(sets[j]) - both)]
    return links


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Words each source is to give: weighted shares, with what is above ``most`` times a source shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in order}
        full |= above


def hard_negatives(rows: list[tuple], positives: int = 5, negatives: int = 3) -> set[tuple]:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of anchors divisible by 50."""
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole = [math.floor(256 * x) for x in vector]
            usable[vec_id] = min(usable.get(vec_id, (label, whole)), (label, whole))
    out = set()
    for a, (label, whole) in usable.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(whole, w)), i, other) for i, (other, w) in usable.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(i, -s) for s, i, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score]
            out |= {(a, p, rank, i, -score, s) for rank, (i, s) in enumerate(fits[:negatives], 1)}
    return out


def token_alignment(texts: list[str | None], first: str, second: str) -> tuple[list[tuple], list[tuple]]:
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text, and its groups' ids."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [i for i in range(256) if i not in printable]
    byte = {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(others)}
    all_groups = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a_tokens = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(raw.decode(), add_special_tokens=False).ids]
        b_tokens = []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            b_tokens.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        groups = []
        if text and b"".join(t for _, t in a_tokens) == raw == b"".join(t for _, t in b_tokens):
            ends = [{sum(len(t) for _, t in side[: k + 1]) for k in range(len(side))} for side in (a_tokens, b_tokens)]
            start = 0
            for end in sorted(ends[0] & ends[1]):
                group, at = [], 0
                for side in (a_tokens, b_tokens):
                    at, held = 0, []
                    for i, t in side:
                        at += len(t)
                        if start < at <= end:
                            held.append(i)
                    group.append(held)
                groups.append(tuple(group))
                start = end
        all_groups.append(groups)
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in all_groups]
    counts = Counter(pair for found in links for pair in set(found))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups, found in zip(all_groups, links):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (
                sum(len(g[0]) for g in groups),
                sum(len(g[1]) for g in groups),
                len(groups),
                len(found),
                sum(counts[p] == most[p[0]] for p in found),
                sum(counts[p] for p in found),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return out, all_groups
