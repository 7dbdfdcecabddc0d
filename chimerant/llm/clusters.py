"""Centroid clustering with exact results at the speed of 32-bit products.

Vectors become integers, floor(SCALE * x). To assign them, a product of 32-bit floats gives, for each vector v and centroid c,
an approximation of |c|^2 - 2 v.c, the squared distance without |v|^2. Whatever the order of adding, a product of
n terms whose factors were rounded errs by at most g |v| |c|, g = (n + 2) u / (1 - (n + 2) u), u = 2^-24; so each distance
has an interval that surely holds it. Centroids whose interval begins above the end of another's are out. Where one is left,
it is the nearest. Where several are left, their distances are computed in 64-bit integers, and the lowest number of the
nearest wins.

A round sends a sum for each task, cluster and component; the driver holds the centroids (k x dim integers) and nothing else.
The vectors are read once for each round: store them first if they are costly to make.

Defined results: vectors of another length, or with null or non-finite components, are left out. Components beyond 2^27 in
units of 1 / SCALE have no distance that fits a long: such vectors are returned without cluster and distance and move
nothing. Rows that share an id are vectors of their own; a row without id is clustered, but is no starting centroid. With fewer
than k vectors each is a centroid. Equal vectors share a cluster. An empty table gives an empty table. Sums that don't
fit a long are null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.llm.common import cut

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
MOST = 1 << 27
ROWS = 8_192


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid of each vector (64-bit integers of at most MOST), and how many needed exact distances."""
    n = v.shape[1]
    g = (n + 2) * 2.0**-24 / (1 - (n + 2) * 2.0**-24)
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    size = np.sqrt((v.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    dots = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c * c).sum(1).astype(np.float64)
    about = squares - 2 * dots
    error = 2 * g * size[:, None] * norm + 2.0**-50 * (squares + 2 * np.abs(dots)) + 1e-6  # the last two: of this line's own rounding
    left = about - error <= (about + error).min(1)[:, None]
    out = left.argmax(1)
    open_ = np.flatnonzero(left.sum(1) > 1)
    best = np.full(len(open_), np.iinfo(np.int64).max)
    for j in range(len(c)):  # ascending, so that the lowest number keeps a tie
        some = np.flatnonzero(left[open_, j])
        d = ((v[open_[some]] - c[j]) ** 2).sum(1)
        nearer = d < best[some]
        best[some[nearer]] = d[nearer]
        out[open_[some[nearer]]] = j
    return out, len(open_)


def _usable(vec: Column, dim: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and whether its components are in range."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, finite), F.lit(False)), F.forall(vec, lambda x: F.abs(x * float(scale)) < MOST)


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dim)


def kept_vectors(vectors: DataFrame, vec_id: str, vec: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, vec, fits) of the vectors that are kept."""
    kind = vectors.schema[vec].dataType
    c = F.col(f"`{vec}`") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else F.col(f"`{vec}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), c.alias("vec"))
    good, fits = _usable(F.col("vec"), dim, scale)
    return rows.filter(good).withColumn("fits", fits)


def starting(kept: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The k vectors of the smallest hashes of `seed:id`; equal hashes are ordered by the vector."""
    named = kept.filter("fits AND vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("h", "vec").limit(k).select("vec").collect()  # k rows
    return np.array([[int(np.floor(scale * float(x))) for x in r.vec] for r in rows], np.int64).reshape(-1, dim)


def _sums(kept: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and componentwise sums of each cluster that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                v = _integers(batch.column(0).slice(at, ROWS), dim, scale)
                own, _ = nearest(v, centroids)
                n += np.bincount(own, minlength=len(centroids))
                for j in np.unique(own):
                    total[j] += v[own == j].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(some, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(some)), np.repeat(n[some], dim), total[some].ravel())], ["cluster", "pos", "n", "s"])

    rows = kept.filter("fits").select("vec").mapInArrow(run, "cluster int, pos int, n long, s long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).orderBy("cluster", "pos").collect():  # k x dim rows at most
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.s))
    return out


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """The centroids after some rounds: floor of the mean, componentwise; those of empty clusters stay."""
    centroids = starting(kept, k, seed, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        for j, (n, sums) in _sums(kept, centroids, dim, scale).items():
            centroids[j] = [s // n for s in sums]
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid and the exact squared distance; null for vectors out of range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fits = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                own, far = np.zeros(len(fits), np.int32), np.zeros(len(fits), np.int64)
                if fits.any() and len(centroids):
                    v = _integers(part.column(1).filter(pa.array(fits)), dim, scale)
                    own[fits], _ = nearest(v, centroids)
                    far[fits] = ((v - centroids[own[fits]]) ** 2).sum(1)
                none = ~fits if len(centroids) else np.ones(len(fits), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32(), mask=none), pa.array(far, pa.int64(), mask=none)], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "vec", "fits").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size."""
    kept = kept_vectors(vectors, vec_id, vec, dim, scale)
    centroids = fit(kept, k, rounds, seed, dim, scale)
    spark = vectors.sparkSession
    rows = cut(assign(kept, centroids, dim, scale), "clusters")
    sums = rows.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # k rows at most
    whole = sum(int(r.s) for r in sums)
    held = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r.cluster, held(int(r.s)), held(whole), digests[r.cluster], r.n) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return rows.join(F.broadcast(facts), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")  # facts: k rows
