"""A seeded order of rows that no machine has to hold: a keyed permutation of row numbers, as a column."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerant.operators.ranges import numbered

ROUNDS = 4
#: A prime below 2^31, so that products of a half and a factor fit a long.
PRIME = (1 << 31) - 1


def keys(seed: int) -> list[tuple[int, int]]:
    """Factor and summand of each round."""
    rnd = random.Random(seed)
    return [(rnd.randrange(1, PRIME), rnd.randrange(PRIME)) for _ in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of a half, so that two halves number n rows."""
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def place(row: Column, n: int, seed: int) -> Column:
    """The place of a row number 0 .. n - 1 in an order of 4^half_bits(n) places: in each round one half is changed by the other
    (a Feistel network), so different rows have different places."""
    size = 1 << half_bits(n)
    left, right = F.floor(row / size).cast("long"), (row % size).cast("long")
    for a, b in keys(seed):
        left, right = right, left.bitwiseXOR((right * F.lit(a) + F.lit(b)) % F.lit(PRIME) % F.lit(size))
    return left * size + right


def split(df: DataFrame, order: list[str], share: float, seed: int, row: str = "row", part: str = "part") -> DataFrame:
    """df with row numbers (from 1, by `order`) and train or holdout: the last `share` of a seeded order, nothing of it on the driver."""
    rows = numbered(df, order, row)
    n = rows.count()
    train = max(1, int(n * (1 - share)))
    placed = numbered(rows.withColumn("_slot", place(F.col(row) - 1, n, seed)), ["_slot"], "_turn")
    return placed.withColumn(part, F.when(F.col("_turn") <= train, "train").otherwise("holdout")).drop("_slot", "_turn")
