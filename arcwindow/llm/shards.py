"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered along a key. A number below ``n`` is a pair of digits ``(l, r)`` in two radices that
are both about the root of ``n``; each round adds a keyed function of one digit to the other, so the rounds
together permute all pairs. The pairs beyond ``n`` (fewer than one radix) are walked along their cycle
until the permutation comes back below ``n``. The permuted number ``p`` gives the shard, ``p % shards``, and
the slot in it, ``p // shards``: the shards' counts are at most one apart and slots have no gaps. Nothing
is looked up and nothing gathered: ``place`` computes shard and slot of a row number, ``row_at`` the
row number that a slot holds, each from ``n``, ``shards`` and ``seed`` alone.

Row numbers come from range partitions whose sizes are added up. The key ends with a hash of the whole row
and the place it was read at, so that neither a key that many rows share nor rows that are wholly equal
meet in one task. Only the latter are told apart by where they were read, and it does not matter which is which.

Defined results: null keys come first; texts that are null have no bytes and the checksum of none; repeated rows
are rows of their own, each with a slot; an empty table gives an empty one; extra columns go along
unchanged, whatever they are called; a name that a new column takes is refused, and ``names`` gives others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from arcwindow.operators.order import row_numbers

SHARDS = 24
SEED = 20_240_229
ROUNDS = 6
#: The rounds' arithmetic is modulo this prime, so that products fit 64 bits (2^31 - 1).
PRIME = 2_147_483_647
#: Rows that can be numbered: radices stay below the prime.
MOST_ROWS = 1 << 61


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, by the minimal standard generator."""
    keys, state = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            state = state * 48_271 % PRIME
            pair.append(state)
        keys.append(tuple(pair))
    return keys


def radices(n: int) -> tuple[int, int]:
    """Two radices whose product is ``n`` or a little more."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(-(-n // a), 1)


def mixed_digit(digit: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """The round function: two shifted squares modulo the prime."""
    x = (digit + key[0]) % PRIME
    x = (x * x + key[1]) % PRIME
    return x * x % PRIME


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where each row number below ``n`` goes."""
    (a, b), keys = radices(n), round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for i, key in enumerate(keys):
            if i % 2 == 0:
                left = (left + mixed_digit(right, key)) % a
            else:
                right = (right + mixed_digit(left, key)) % b
        return left * b + right

    return walked(numbers, n, once)


def restored(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that ``permuted`` takes to these places."""
    (a, b), keys = radices(n), round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for i, key in reversed(list(enumerate(keys))):
            if i % 2 == 0:
                left = (left - mixed_digit(right, key)) % a
            else:
                right = (right - mixed_digit(left, key)) % b
        return left * b + right

    return walked(places, n, once)


def walked(numbers: np.ndarray, n: int, once) -> np.ndarray:
    out = once(np.asarray(numbers, dtype=np.int64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = once(out[beyond])
    return out


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """``shard, slot`` of a row number."""
    p = int(permuted(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number in a slot."""
    return int(restored(np.array([slot * shards + shard]), n, seed)[0])


def sharded(
    rows: DataFrame,
    key: str,
    shards: int = SHARDS,
    seed: int = SEED,
    names: tuple[str, str, str] = ("row_number", "shard", "slot"),
) -> DataFrame:
    """The rows with their number along ``key`` (from 0), shard and slot."""
    if taken := {c.lower() for c in names} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(taken)} are there already; give other names")
    given = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*given)
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in plain.dtypes])
    order = [given[rows.columns.index(key)], "hash", "read"]
    keyed = plain.withColumns({"hash": whole, "read": F.monotonically_increasing_id()})
    numbered = row_numbers(keyed, order, "number").withColumn("number", F.col("number") - 1)
    n = numbered.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows are more than {MOST_ROWS}")

    @F.pandas_udf("bigint")
    def permuted_(numbers):
        return numbers.__class__(permuted(numbers.to_numpy(), n, seed))

    placed = numbered.select(*given, "number", permuted_("number").alias("place"))
    return placed.select(
        *[F.col(c).alias(name) for c, name in zip(given, rows.columns)],
        F.col("number").alias(names[0]),
        (F.col("place") % shards).cast("int").alias(names[1]),
        F.expr(f"place div {shards}").alias(names[2]),
    )


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots."""
    dealt = placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.partitionBy(shard).parquet(path)
