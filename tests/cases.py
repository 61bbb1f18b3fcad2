"""Small corpora for the tests."""

from __future__ import annotations

import random

from tests.plain import FIELDS

TAGS = ["NN", "NNS", "JJ", "VVZ", "VVG", "VVD", "MD", "IN", "RB", "DT", "N"]
RELATIONS = ["NMOD", "SBJ", "OBJ", "VC", "ADV", "PRN", "PRD"]
WORDS = ["red", "Red", "car", "cars", "sell", "be", "the", "Well-known", "x--y", "été", "a1"]

RED_CAR = """<text id="a">
<s>
The\tthe\tDT\t1\t3\tNMOD
red\tred\tJJ\t2\t3\tNMOD
car\tcar\tNN\t3\t4\tSBJ
has\thave\tVHZ\t4\t0\tROOT
been\tbe\tVBN\t5\t4\tVC
sold\tsell\tVVN\t6\t5\tVC
</s>
</text>
"""


def sentence(rng: random.Random, n: int, wild: bool = False) -> list[dict]:
    """Tokens with ids 1..n; ``wild`` heads may be missing or the token itself."""
    tokens = []
    for i in range(1, n + 1):
        word = rng.choice(WORDS)
        head = rng.randint(0, n + 2 if wild else n)
        if not wild and head == i:
            head = 0
        values = (word, word.lower(), rng.choice(TAGS), str(i), str(head), rng.choice(RELATIONS))
        tokens.append(dict(zip(FIELDS, values)))
    return tokens


def sentences(seed: int, n: int, longest: int = 12, wild: bool = False) -> list[list[dict]]:
    rng = random.Random(seed)
    return [sentence(rng, rng.randint(0, longest), wild) for _ in range(n)]


def write(folder, text: str, name: str = "corpus.txt") -> str:
    path = folder / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def lines_of(df, column: str = "line") -> list[str]:
    return [r[column] for r in df.collect()]
