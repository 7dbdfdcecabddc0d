"""Exact cosine neighbours of sparse rows (row, token, weight >= 0), by inverted lists of blocks with their largest weights.

1. Rows of equal vectors are one vector, with its smallest row numbers; so copies cost nothing, whatever their number.
2. Vectors are ordered by their heaviest tokens and dealt by ranges into blocks, so like vectors lie together.
3. A block's summary is the largest weight that each token has in it. The sum over a vector's tokens of its weight times
   that largest weight is a cosine that no vector of the block exceeds.
4. Vectors first meet those of their own block: the k-th best cosine there is one that a neighbour must reach. The bounds of
   all blocks are products of vectors with summaries, a block of BLOCK vectors costing as much as one vector would.
5. A vector is sent to the blocks whose bound reaches what it has, and to no others; products of packed blocks give the
   exact cosines. No pair of rows is a row of a table.

Tokens are told apart by 64 bits, where published runs keep 18. Cosines are rounded to DIGITS; ties go to smaller row numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerant.operators import ranges
from chimerant.operators.storage import stored

BLOCK, CHUNK, SUMMARIES, DIGITS = 64, 4_096, 1_024, 6
SALTS = 64
_NEAR = pa.schema([("v", pa.int64()), ("blk", pa.int64()), ("other", pa.int64()), ("w", pa.float64())])
_NEAR_SQL = "v long, blk long, other long, w double"


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, token, weight) of the tokens of a packed table."""
    lists = table.column("x").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), flat.field("t").to_numpy(), flat.field("w").to_numpy()


def _products(left: pa.Table, right: pa.Table) -> np.ndarray:
    """All inner products of two packed tables, some thousand shared tokens at a time."""
    (at, token, w), (other_at, other_token, other_w) = _unpack(left), _unpack(right)
    shared = np.intersect1d(token, other_token)  # tokens that one side alone has add nothing
    out = np.zeros((left.num_rows, right.num_rows))
    for begin in range(0, len(shared), 4_096):
        some = shared[begin : begin + 4_096]
        a, b = np.zeros((left.num_rows, len(some))), np.zeros((right.num_rows, len(some)))
        for matrix, i, t, x in ((a, at, token, w), (b, other_at, other_token, other_w)):
            place = np.minimum(np.searchsorted(some, t), len(some) - 1)
            hit = some[place] == t
            matrix[i[hit], place[hit]] = x[hit]
        out += a @ b.T
    return out


def _meet(k: int):
    """The k best vectors of a block for each vector that is sent to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NEAR.empty_table()
        rows, own, others = left.column("v").to_numpy(), left.column("own").to_numpy(), right.column("v").to_numpy()
        cosines = np.round(_products(left, right), DIGITS)
        order = np.lexsort((np.broadcast_to(others, cosines.shape), -cosines), axis=1)[:, :k]
        i = np.repeat(np.arange(len(rows)), order.shape[1])
        return pa.table([rows[i], own[i], others[order.ravel()], cosines[i, order.ravel()]], schema=_NEAR)

    return run


def _reach(left: pa.Table, right: pa.Table) -> pa.Table:
    """(v, own, blk, n): the blocks, other than its own, whose bound reaches the least cosine that a vector has to reach."""
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, ["v", "own", "blk", "n"])
    bound = _products(left, right) + 1e-9
    own, blk, least = left.column("own").to_numpy(), right.column("blk").to_numpy(), left.column("least").to_numpy(zero_copy_only=False)
    i, j = np.nonzero((bound >= least[:, None] - 10.0**-DIGITS) & (bound > 1e-9) & (own[:, None] != blk[None, :]))
    return pa.table([left.column("v").to_numpy()[i], own[i], blk[j], right.column("n").to_numpy()[j]], ["v", "own", "blk", "n"])


def packed(feats: DataFrame) -> DataFrame:
    """(row, x): unit vectors as sorted lists of (t, w). Rows of weight 0 have none."""
    tokens = feats.groupBy("row", F.xxhash64("token").alias("t")).agg(F.sum("weight").alias("w")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("x"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    return tokens.withColumn("size", size).filter("size > 0").select("row", F.transform("x", lambda e: F.struct(e["t"].alias("t"), F.round(e["w"] / F.col("size"), 12).alias("w"))).alias("x"))


def _smallest(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k smallest rows of each vector; a vector's rows first meet in SALTS parts."""
    some = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    for key in ([by, "salt"], [by]):
        some = some.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).filter(F.col("_r") <= k)
    return some.select(by, "row")


def _blocks(vectors: DataFrame, order: str, block: int, n: int) -> DataFrame:
    """(v, x, own): vectors in blocks of about `block`, each a run of places in a range of the order, none much smaller than the others."""
    dealt = stored(ranges.ordered(vectors, [order], max(1, min(2_000, n // (4 * block)))).drop(order), "cosine-ranges")
    sizes = dealt.groupBy(ranges.PART).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range, 2,000 at most
    place = F.floor(F.col(ranges.AT) * F.greatest(F.lit(1), F.floor(F.col("_n") / block)) / F.col("_n"))
    return stored(dealt.join(F.broadcast(sizes), ranges.PART).select("v", "x", (F.col(ranges.PART).cast("long") * (1 << 32) + place).alias("own")), "cosine-vectors")


def cosine_lists(feats: DataFrame, k: int, block: int = BLOCK) -> tuple[DataFrame, dict[str, int]]:
    """(row, other, w): the k nearest of each row, itself among them, of cosines over 0; and how many pairs of vectors there are and were looked at."""
    rows = stored(packed(feats).withColumn("c", F.struct(F.xxhash64("x"), F.xxhash64("x", F.lit(1)))), "cosine-rows")
    vectors = rows.groupBy("c").agg(F.min("row").alias("v"), F.first("x").alias("x"))
    heaviest = F.array_sort(F.transform("x", lambda e: F.struct((-F.round(e["w"], 1)).alias("w"), e["t"].alias("t"))))
    n = vectors.count()
    counts = {"rows": rows.count(), "pairs": n * n, "visited": 0}
    table = _blocks(vectors.select("v", "x", heaviest.alias("h")), "h", block, n)

    inside = table.toDF("v", "x", "blk")  # columns of its own, as both sides of a cogroup may come from one table
    first = stored(table.withColumn("blk", F.col("own")).groupBy("blk").cogroup(inside.groupBy("blk")).applyInArrow(_meet(k), _NEAR_SQL), "cosine-first")
    counts["visited"] += int(inside.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
    least = first.groupBy("v").agg(F.when(F.count(F.lit(1)) >= k, F.min("w")).otherwise(0.0).alias("least"))
    sides = max(1, -(-n // CHUNK))
    wanting = table.join(least, "v").withColumn("i", F.pmod(F.xxhash64("own"), F.lit(sides)).cast("int"))

    largest = inside.select("blk", F.explode("x").alias("e")).groupBy("blk", "e.t").agg(F.max("e.w").alias("w")).groupBy("blk").agg(F.collect_list(F.struct("t", "w")).alias("x"))
    summary = stored(largest.join(inside.groupBy("blk").agg(F.count(F.lit(1)).alias("n")), "blk"), "cosine-summary")
    boards = max(1, -(-summary.count() // SUMMARIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = wanting.withColumn("j", every(boards))
    right = summary.withColumn("j", F.pmod(F.xxhash64("blk"), F.lit(boards)).cast("int")).withColumn("i", every(sides))
    reach = stored(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_reach, "v long, own long, blk long, n long"), "cosine-reach")
    counts["visited"] += int(reach.agg(F.sum("n")).first()[0] or 0)

    # What is sent to a block comes in parts of CHUNK vectors or so, and the block to each of them.
    sent = reach.join(reach.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")), "blk").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    guests = sent.select("v", "blk", "part").join(table, "v")
    hosts = sent.select("blk", "part").distinct().join(inside, "blk").toDF("blk", "part", "v", "x")
    more = guests.groupBy("blk", "part").cogroup(hosts.groupBy("blk", "part")).applyInArrow(_meet(k), _NEAR_SQL)
    best = first.unionByName(more).filter("w > 0").withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("w"), "other"))).filter(F.col("_r") <= k)

    # From vectors to rows: a vector's neighbours are rows of its near vectors, the same for all rows that it stands for.
    named = stored(rows.join(vectors.select("c", "v"), "c").select("row", "v"), "cosine-names")
    members = _smallest(named, "v", k).select(F.col("v").alias("other"), F.col("row").alias("near"))
    lists = best.select("v", "other", "w").join(members, "other").withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("w"), "near"))).filter(F.col("_r") <= k)
    return named.join(stored(lists.select("v", "near", "w"), "cosine-lists"), "v").select("row", F.col("near").alias("other"), "w"), counts
