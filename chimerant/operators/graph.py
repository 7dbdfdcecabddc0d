"""Label diffusion over a nearest-neighbour graph kept as an edge table (src, dst, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chimerant.operators.ranges import numbered, running_totals
from chimerant.operators.storage import bucketed, removed, stored


def symmetrise(edges: DataFrame) -> DataFrame:
    """(A + transposed A) / 2 with similarities below 0 as 0, no loops and no zero edges."""
    half = edges.select("src", "dst", (F.greatest(F.col("w"), F.lit(0.0)) / 2).alias("w"))
    return half.union(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w > 0")


def row_stochastic(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    return edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("w"))


def knn_graph(vectors: DataFrame, k: int, node: str = "id", vec: str = "vec") -> DataFrame:
    """Symmetric cosine graph of each node's k nearest, itself among them."""
    from chimerant.functions.vectors import normalised
    from chimerant.operators.vectors import search

    unit = vectors.select(F.col(node).alias("node"), normalised(F.col(vec)).alias("vec"))
    hits = search(unit, unit, k, "node", "node")
    return symmetrise(hits.select(F.col("query").alias("src"), F.col("item").alias("dst"), F.col("score").alias("w")))


def step(p: DataFrame, scores: DataFrame, alpha: float) -> DataFrame:
    """s' = alpha P s + (1 - alpha) y; scores is (node, y, s)."""
    spread = p.join(scores.select(F.col("node").alias("dst"), "s"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("s")).alias("in"))
    return scores.join(spread, "node", "left").select("node", "y", (alpha * F.coalesce("in", F.lit(0.0)) + (1 - alpha) * F.col("y")).alias("s"))


#: Graphs of so many edges and nodes at most are diffused on the driver: 24 bytes an edge.
LOCAL_EDGES = 1_000_000
#: Larger graphs of so many nodes at most are diffused over packed edges, with one number for each node on the driver: 8 bytes a node.
LOCAL_NODES, PIECE_EDGES = 8_000_000, 250_000
#: Edges of a bucket of still larger ones, as long as there are not more buckets than shuffle partitions.
BUCKET_EDGES = 500_000


def _diffuse_local(p: DataFrame, seeds: DataFrame, alpha: float, max_iterations: int, tolerance: float) -> DataFrame:
    import pandas as pd

    e, s0 = p.select("src", "dst", "w").toPandas(), seeds.select("node", "y").toPandas()
    nodes = s0["node"].to_numpy()
    at = pd.Series(np.arange(len(nodes)), index=nodes)
    src, dst = at.reindex(e["src"]).to_numpy(), at.reindex(e["dst"]).to_numpy()
    known = ~(np.isnan(src) | np.isnan(dst)) if len(e) else np.zeros(0, bool)
    src, dst, w = src[known].astype(int), dst[known].astype(int), e["w"].to_numpy()[known]
    y = s0["y"].to_numpy(float)
    s = y
    for _ in range(max_iterations):
        new = alpha * np.bincount(src, w * s[dst], len(y)) + (1 - alpha) * y
        change, s = np.abs(new - s).sum(), new
        if change < tolerance:
            break
    return p.sparkSession.createDataFrame(pd.DataFrame({"node": nodes, "y": y, "s": s}), "node long, y double, s double")


def bucketed_step(edges: DataFrame, scores: DataFrame, alpha: float) -> DataFrame:
    """(node, y, s, old): a step on edges bucketed by dst and scores bucketed by node, in as many buckets.

    Edges meet the scores of their ends where both lie; what moves is one partial sum for each source of a bucket."""
    spread = edges.join(scores.select(F.col("node").alias("dst"), "s").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("s")).alias("in"))
    return scores.join(spread, "node", "left").select("node", "y", (alpha * F.coalesce("in", F.lit(0.0)) + (1 - alpha) * F.col("y")).alias("s"), F.col("s").alias("old"))


def diffuse(p: DataFrame, seeds: DataFrame, alpha: float = 0.9, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Diffusion with restart until the L1 change is below the tolerance: (node, y, s). seeds is (node, y).

    Graphs of LOCAL_EDGES at most are diffused on the driver, larger ones of LOCAL_NODES at most over packed edges, others by tables."""
    p = stored(p, "diffusion-graph")  # once, not once for its count and once for its rows
    n_edges, n_nodes = p.count(), seeds.count()
    if n_edges <= LOCAL_EDGES and n_nodes <= LOCAL_EDGES:
        return _diffuse_local(p, seeds, alpha, max_iterations, tolerance)
    if n_nodes <= LOCAL_NODES:
        return _diffuse_packed(p, seeds, alpha, max_iterations, tolerance, n_edges)
    return diffuse_bucketed(p, seeds, alpha, max_iterations, tolerance)


def _pack(at):
    """(src, dst, w) to pieces of about PIECE_EDGES, `at` being the broadcast nodes in order: places of their sources, where each one's edges begin, places of their ends, weights."""

    def piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes = at.value
        src, dst, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        i, j = (np.minimum(np.searchsorted(nodes, x), len(nodes) - 1) for x in (src, dst))
        known = (nodes[i] == src) & (nodes[j] == dst)
        i, j, w = i[known], j[known], w[known]
        order = np.argsort(i, kind="stable")
        rows, first = np.unique(i[order], return_index=True)
        columns = [rows.astype(np.int32), first.astype(np.int32), j[order].astype(np.int32), w[order].astype(np.float64)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["rows", "first", "dst", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PIECE_EDGES:
                yield piece(held)
                held, n = [], 0
        if n:
            yield piece(held)

    return run


def _diffuse_packed(p: DataFrame, seeds: DataFrame, alpha: float, max_iterations: int, tolerance: float, n_edges: int) -> DataFrame:
    """The edges are packed once; a step is one job without an exchange: tasks get the scores by broadcast and send back a sum for each source."""
    sc = p.sparkSession.sparkContext
    seeds = stored(seeds.select(F.col("node").cast("long").alias("node"), F.col("y").cast("double").alias("y")), "diffusion-seeds")
    s0 = seeds.toArrow()
    nodes, y = s0.column("node").to_numpy(), s0.column("y").to_numpy()
    order = np.argsort(nodes)
    nodes, y = nodes[order], y[order]
    parts = max(sc.defaultParallelism, -(-n_edges // (4 * PIECE_EDGES)))
    at = sc.broadcast(nodes)
    pieces = stored(p.select("src", "dst", "w").repartition(parts, "src").mapInArrow(_pack(at), "rows binary, first binary, dst binary, w binary"), "diffusion-pieces")
    removed(p)

    def step_over(s: np.ndarray) -> np.ndarray:
        sent, total = sc.broadcast(s), np.zeros(len(s))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for first, dst, w in zip(*(batch.column(c) for c in ("first", "dst", "w")), strict=True):
                    first, dst, w = np.frombuffer(first.as_buffer(), np.int32), np.frombuffer(dst.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float64)
                    sums.append((np.add.reduceat(w * sent.value[dst], first) if len(first) else np.zeros(0)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("rows"), pa.array(sums, pa.binary())], ["rows", "sums"])

        for r in pieces.mapInArrow(run, "rows binary, sums binary").collect():
            total[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["sums"], np.float64)  # a source stands once in a piece
        sent.destroy()
        return total

    s = y
    for _ in range(max_iterations):
        new = alpha * step_over(s) + (1 - alpha) * y
        change, s = np.abs(new - s).sum(), new
        if change < tolerance:
            break
    removed(pieces)
    last = sc.broadcast(s)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = last.value[np.searchsorted(at.value, batch.column(0).to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["node", "y", "s"])

    return seeds.mapInArrow(scored, "node long, y double, s double")


def diffuse_bucketed(p: DataFrame, seeds: DataFrame, alpha: float = 0.9, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """diffuse() by tables: the edges are bucketed once and never move again. Every iterate is a bucketed table in the folder of
    spark.checkpoint.dir, so lineage stays short and lost executors cost one step; the one before it is removed."""
    spark = p.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    p = stored(p.select("src", "dst", "w"), "diffusion-graph")
    buckets = min(int(before), max(spark.sparkContext.defaultParallelism, -(-p.count() // BUCKET_EDGES)))
    spark.conf.set("spark.sql.shuffle.partitions", buckets)  # a small graph isn't cut into as many files as a large one
    try:
        edges = bucketed(p, "diffusion_edges", "dst")
        y = F.col("y").cast("double")
        scores = bucketed(seeds.select("node", y.alias("y"), y.alias("s")), "diffusion", "node")
        for _ in range(max_iterations):
            change = Observation()
            step_ = bucketed_step(edges, scores, alpha).observe(change, F.sum(F.abs(F.col("s") - F.col("old"))).alias("change"))
            new = bucketed(step_, "diffusion", "node")  # the change is summed as the table is written
            removed(scores)
            scores = new
            if (change.get["change"] or 0.0) < tolerance:
                break
        removed(edges)
        removed(p)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return scores.select("node", "y", "s")


def rescale(scores: DataFrame, value: str = "s", out: str = "score") -> DataFrame:
    """Min-max over all rows; 0 where the range vanishes."""
    bounds = scores.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    return scores.join(F.broadcast(bounds)).withColumn(out, F.when(F.col("_hi") - F.col("_lo") >= 1e-12, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def ranked(scores: DataFrame, value: str, tie: str, out: str = "rank") -> DataFrame:
    """Global descending rank, ties by a key. No task sees more than a range of the scores."""
    return numbered(scores, [F.desc(value), F.col(tie)], out)


def ranking_metrics(ranks: DataFrame, ks: list[int], relevant: str = "relevant", value: str = "score", rank: str = "rank") -> DataFrame:
    """(k, recall_at_k, ef_at_k, ndcg_at_k, average_precision) of a ranked table with a 0/1 column.

    Rows that tie share one place in average precision; k is held within 1..n; without relevant rows all are 0."""
    n, positives = ranks.agg(F.count(F.lit(1)), F.sum(relevant)).first()
    positives = int(positives or 0)
    spark = ranks.sparkSession
    if not n or not positives:
        return spark.createDataFrame([(k, 0.0, 0.0, 0.0, 0.0) for k in ks], "k int, recall_at_k double, ef_at_k double, ndcg_at_k double, average_precision double")
    held = [max(1, min(k, n)) for k in ks]
    gain = F.col(relevant) / F.log2(F.col(rank) + 1)
    sums = ranks.filter(F.col(rank) <= max(held)).agg(*(F.sum(F.when(F.col(rank) <= k, F.col(relevant))).alias(f"tp{i}") for i, k in enumerate(held)), *(F.sum(F.when(F.col(rank) <= k, gain)).alias(f"dcg{i}") for i, k in enumerate(held))).first()
    ties = ranks.groupBy(value).agg(F.sum(relevant).alias("tp"), F.max(rank).alias("seen")).filter("tp > 0")
    ap = running_totals(ties, [F.desc(value)], {"cum": "tp"}).agg(F.sum(F.col("tp") / positives * F.col("cum") / F.col("seen"))).first()[0]
    import math

    rows = []
    for i, k in enumerate(held):
        ideal = sum(1 / math.log2(j + 2) for j in range(min(k, positives)))
        rows.append((k, sums[f"tp{i}"] / positives, sums[f"tp{i}"] / k / (positives / n), float(sums[f"dcg{i}"]) / ideal, float(ap)))
    return spark.createDataFrame(rows, "k int, recall_at_k double, ef_at_k double, ndcg_at_k double, average_precision double")
