"""Exact vector search that skips what bounds rule out.

An index of one shard meets the queries block by block, each block pair being one matrix product. A larger one is laid out
first: a few pivots are chosen, each vector goes to the cell of its nearest pivot, and vectors are dealt by ranges of (cell,
distance) into blocks. Of a block only the least and largest distances to each pivot, the largest norm and the number of
vectors are kept as its summary. By the triangle inequality no vector of a block is nearer to a query than the
largest gap between the query's own distances to the pivots and the block's; with the norm that bounds inner products too.
A query meets the blocks of the best bounds first, which gives the score that its k-th best has at least, and then
those that may hold a better one. All others are skipped, which loses nothing.

Queries are dealt to a fixed number of chunks and packed blocks to boards; each chunk meets each board in one task, and a
task keeps k items of a query. So what is moved grows with queries and items, not with their pairs: an index of which bounds
rule out nothing costs products alone. Only where a chunk or board would have more bytes than a task should hold are there more of
them. Summaries have a bound in bytes, whatever the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerant.operators import ranges
from chimerant.operators.storage import stored

SHARD_ROWS, BLOCK_ROWS, CHUNK_ROWS = 16_384, 1_024, 2_048
PIVOTS, SUMMARY_BYTES = 32, 64 << 20
#: The index is sent to so many chunks of queries, as long as a chunk and a board of blocks have no more bytes than these.
CHUNKS, CHUNK_BYTES, BOARD_BYTES = 24, 64 << 20, 128 << 20
_HITS = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(flat[0]) if len(flat) else 0
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Top:
    """The k best items of each query so far: best scores first, of equal ones the smaller id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int, metric: str, exclude_self: bool, digits: int):
        self.m, self.ids, self.k, self.ip, self.exclude_self, self.digits = vectors, ids, k, metric == "ip", exclude_self, digits
        self.size = (vectors * vectors).sum(1)
        self.scores, self.items = np.full((len(vectors), k), -np.inf), np.full((len(vectors), k), np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Queries, by ascending row, meet a block of items."""
        for at in range(0, len(rows), CHUNK_ROWS):
            for begin in range(0, len(vectors), BLOCK_ROWS):
                self._meet(rows[at : at + CHUNK_ROWS], vectors[begin : begin + BLOCK_ROWS], ids[begin : begin + BLOCK_ROWS])

    def _meet(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        found = self.m[rows] @ vectors.T
        if not self.ip:
            found *= 2
            found -= self.size[rows][:, None]
            found -= (vectors * vectors).sum(1)[None, :]
        if self.exclude_self:
            found[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        least, last = self.scores[rows, -1], self.items[rows, -1]
        if self.k < len(vectors) and np.isneginf(least).any():  # a block alone has k items: no other can be better
            with np.errstate(invalid="ignore"):
                low = np.partition(np.where(np.isfinite(found), found, -np.inf), -self.k, axis=1)[:, -self.k]
        else:
            low = least
        i, j = np.nonzero(found >= (np.maximum(least, low) - 10.0**-self.digits)[:, None])
        score = np.round(found[i, j], self.digits) + 0.0
        good = np.isfinite(score) & ((score > least[i]) | ((score == least[i]) & (ids[j] < last[i])))
        i, j, score = i[good], j[good], score[good]
        if not len(i):
            return
        own = np.unique(i)
        row = np.concatenate([np.repeat(own, self.k), i])
        score = np.concatenate([self.scores[rows[own]].ravel(), score])
        item = np.concatenate([self.items[rows[own]].ravel(), ids[j]])
        order = np.lexsort((item, -score, row))
        place = np.arange(len(order)) - np.repeat(np.searchsorted(row[order], own), np.bincount(row[order])[own])
        kept = order[place < self.k]
        self.scores[rows[own]], self.items[rows[own]] = score[kept].reshape(-1, self.k), item[kept].reshape(-1, self.k)

    def table(self) -> pa.Table:
        there = np.isfinite(self.scores)
        return pa.table([np.repeat(self.ids, there.sum(1)), self.items[there], self.scores[there]], schema=_HITS)


def _best(k: int, metric: str, exclude_self: bool, digits: int):
    """The k best items of a block for each query of a chunk."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _HITS.empty_table()
        top = _Top(_matrix(a.column("vec")), a.column("id").to_numpy(), k, metric, exclude_self, digits)
        top.meet(np.arange(a.num_rows), _matrix(b.column("vec")), b.column("id").to_numpy())
        return top.table()

    return run


_FOUND = "query long, item long, score double"


def _top(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str, query_vec: str = "vec", index_vec: str = "vec", metric: str = "ip", exclude_self: bool = False, block: int = 2048, digits: int = 6) -> DataFrame:
    """(query, item, score, rank): the k best items of each query, score rounded, ties by item; l2 scores are negative distances.

    Ids are BIGINT. Rows without a vector match nothing."""
    q = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast("array<double>").alias("vec"))
    x = index.filter(F.col(index_vec).isNotNull()).select(F.col(index_id).cast("long").alias("id"), F.col(index_vec).cast("array<double>").alias("vec"))
    if x.count() > SHARD_ROWS:
        return bounded_search(q, x, k, metric, exclude_self, block, digits)[0]
    chunks = _chunks(q.count(), block, 0)
    left = q.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    right = x.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return _top(stored(left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(_best(k, metric, exclude_self, digits), _FOUND), "search-hits"), k)


def _chunks(asked: int, block: int, width: int) -> int:
    """Chunks of about `block` queries, CHUNKS at most unless these would be too large for a task."""
    return max(1, min(-(-asked // block), max(CHUNKS, -(-asked * max(64, width) * 8 // CHUNK_BYTES))))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By differences, not by products: near vectors keep their digits."""
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], 1)


def _laid_out(x: DataFrame, pivots: np.ndarray, rows: int, parts: int) -> DataFrame:
    """The index as a stored table (blk, id, vec, norm, far): far has the distances to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            far = _distances(v, pivots) if len(v) else np.zeros((0, len(pivots)))
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            cell = far.argmin(1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt((v * v).sum(1))), pa.ListArray.from_arrays(ends, pa.array(far.ravel())), pa.array(cell.astype(np.int32)), pa.array(far.min(1) if len(v) else np.zeros(0))], ["id", "vec", "norm", "far", "cell", "d"])

    cells = x.mapInArrow(run, "id long, vec array<double>, norm double, far array<double>, cell int, d double")
    dealt = ranges.ordered(cells, ["cell", "d"], parts)
    # A block never reaches over two ranges; its number tells range and place.
    blk = F.col(ranges.PART).cast("long") * (1 << 32) + F.floor(F.col(ranges.AT) / rows)
    return stored(dealt.select(blk.alias("blk"), "id", "vec", "norm", "far"), "search-index")


class _Summary:
    """What is kept of the blocks: least and largest distances to each pivot, the largest norm, and the number of vectors."""

    def __init__(self, table: DataFrame, pivots: np.ndarray):
        at = range(len(pivots))
        rows = table.groupBy("blk").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), *(F.min(F.col("far")[i]).alias(f"lo{i}") for i in at), *(F.max(F.col("far")[i]).alias(f"hi{i}") for i in at)).orderBy("blk").toPandas()
        self.blk, self.n, self.norm = (rows[c].to_numpy() for c in ("blk", "n", "norm"))
        self.lo, self.hi, self.pivots = rows[[f"lo{i}" for i in at]].to_numpy(), rows[[f"hi{i}" for i in at]].to_numpy(), pivots

    def bounds(self, v: np.ndarray, metric: str, here: np.ndarray) -> np.ndarray:
        """No vector of a block has a better score than this, for each query and each block of a mask; a hair is added for rounding."""
        lo, hi, norm = self.lo[here], self.hi[here], self.norm[here]
        far, gap = _distances(v, self.pivots), np.zeros((len(v), len(norm)))
        for i in range(len(self.pivots)):
            d = far[:, i, None]
            np.maximum(gap, np.maximum(d - hi[None, :, i], lo[None, :, i] - d), out=gap)
        size = np.sqrt((v * v).sum(1))[:, None]
        hair = 1e-9 * (size + norm) ** 2 + 1e-12
        near = gap * gap
        return (-near if metric != "ip" else np.minimum((size * size + norm * norm - near) / 2, size * norm)) + hair


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row."""
    v, ids = _matrix(table.column("vec")), table.column("id").to_numpy()
    return pa.table([[table.column("blk")[0].as_py()], [ids.tobytes()], [v.tobytes()]], schema=pa.schema([("blk", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())]))


def _by_bounds(summary: _Summary, k: int, metric: str, exclude_self: bool, digits: int):
    """The k best items of a board of blocks for each query of a chunk, and a row without query: how many pairs were looked at."""
    want, unit = k + exclude_self, 10.0**-digits

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _HITS.empty_table()
        held = {blk: (np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.float64)) for blk, ids, v in zip(b.column("blk").to_pylist(), b.column("ids"), b.column("vecs"), strict=True)}
        blocks = [(ids, v.reshape(len(ids), -1)) for _, (ids, v) in sorted(held.items())]
        here = np.isin(summary.blk, list(held))
        sizes, seen, out = summary.n[here], 0, []
        for at in range(0, a.num_rows, CHUNK_ROWS):
            part = a.slice(at, CHUNK_ROWS)
            v = _matrix(part.column("vec"))
            top = _Top(v, part.column("id").to_numpy(), k, metric, exclude_self, digits)
            bound = summary.bounds(v, metric, here)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(sizes[order], 1) - sizes[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < want, 1)
            for second in (False, True):
                for i, (ids, vectors) in enumerate(blocks):
                    rows = np.flatnonzero(~first[:, i] & (bound[:, i] >= top.scores[:, -1] - unit) if second else first[:, i])
                    seen += len(rows) * len(ids)
                    if len(rows):
                        top.meet(rows, vectors, ids)
            out.append(top.table())
        return pa.concat_tables([*out, pa.table([pa.array([None], pa.int64()), pa.array([seen], pa.int64()), pa.array([None], pa.float64())], schema=_HITS)])

    return run


def bounded_search(q: DataFrame, x: DataFrame, k: int, metric: str = "ip", exclude_self: bool = False, chunk: int = 2048, digits: int = 6, rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS) -> tuple[DataFrame, dict[str, int]]:
    """search() over (id, vec) tables by bounds; and how many (query, item) pairs there are and how many were looked at."""
    n, asked = x.count(), q.count()
    if not n or not asked:
        return x.sparkSession.createDataFrame([], _FOUND + ", rank int"), {"pairs": 0, "visited": 0}
    pivots = np.array([r.vec for r in x.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()], float)  # a stated number of vectors
    rows = max(rows, n * 16 * (len(pivots) + 1) // SUMMARY_BYTES)
    table = _laid_out(x, pivots, rows, max(1, min(2_000, n // rows)))
    summary = _Summary(table, pivots)
    width = pivots.shape[1]
    chunks = _chunks(asked, chunk, width)
    boards = max(1, -(-n * width * 8 // BOARD_BYTES), min(-(-CHUNKS // chunks), len(summary.blk) // 64))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("int")).withColumn("board", every(boards))
    packed = table.select("blk", "id", "vec").groupBy("blk").applyInArrow(_pack, "blk long, ids binary, vecs binary")
    right = packed.withColumn("board", F.pmod(F.xxhash64("blk"), F.lit(boards)).cast("int")).withColumn("chunk", every(chunks))
    hits = left.groupBy("chunk", "board").cogroup(right.groupBy("chunk", "board")).applyInArrow(_by_bounds(summary, k, metric, exclude_self, digits), _FOUND)
    hits = stored(hits, "search-hits")
    seen = hits.filter("query IS NULL").agg(F.sum("item")).first()[0] or 0
    return _top(hits.filter("query IS NOT NULL"), k), {"pairs": n * asked, "visited": int(seen)}


def first_unique(hits: DataFrame, label: str, k: int, by: str = "query") -> DataFrame:
    """The first k distinct labels of each query in rank order, by their best scores."""
    best = hits.groupBy(by, label).agg(F.max("score").alias("best"), F.min("rank").alias("first"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("first"))).filter(F.col("place") <= k)


def group_mean(df: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """The mean vector of each key, as rows (key, pos, value)."""
    return df.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
