"""Driver scores: label diffusion from known positives over a graph of nearest neighbours.

Features stay sparse rows (row, token, weight). Neighbours come from an exact search that skips what bounds rule out. Numeric features are eight tokens of their own,
unscaled beside the unit-length text part, as published.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerant.config import DOMAIN_COLUMNS, Config
from chimerant.functions.text import count_tokens, side_tokens
from chimerant.operators import graph, shuffling, sparse
from chimerant.operators.storage import stored
from chimerant.operators.ranges import numbered
from chimerant.sources.tables import require

OLD_NAMES = {"retained_iprs1": "retained_domains1", "lost_iprs1": "lost_domains1", "retained_iprs2": "retained_domains2", "lost_iprs2": "lost_domains2"}
CORE = ["id", "gene1", "gene2", *DOMAIN_COLUMNS, "out_of_frame1", "out_of_frame2"]


def aligned(df: DataFrame, source: str) -> DataFrame:
    """The core columns of a table, older names renamed, missing ones null, with its source."""
    df = df.withColumnsRenamed({a: b for a, b in OLD_NAMES.items() if a in df.columns and b not in df.columns})
    require(df, DOMAIN_COLUMNS)
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in CORE), F.lit(source).alias("source"))


def tfidf(tokens: DataFrame, norm: str = "l2", binary: bool = False) -> DataFrame:
    """(row, token, weight) from one row per occurrence (row, token): smoothed idf, then rows of unit norm."""
    n = tokens.select("row").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    tf = tokens.groupBy("row", "token").agg(F.count(F.lit(1)).alias("tf"))
    if binary:
        return tf.select("row", "token", F.lit(1.0).alias("weight"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "token").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    if norm == "none":
        return w.select("row", "token", F.col("w").alias("weight"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w"))) if norm == "l2" else F.sum(F.abs("w"))
    norms = w.groupBy("row").agg(size.alias("_n"))
    return w.join(norms, "row").select("row", "token", (F.col("w") / F.col("_n")).alias("weight"))


def numeric(df: DataFrame) -> dict[str, Column]:
    """The eight numeric features of an event."""
    frame = lambda s: F.coalesce(F.col(f"out_of_frame{s}").try_cast("double"), F.lit(2.0))
    names = ["r1", "l1", "r2", "l2"]
    return {"of1": frame(1), "of2": frame(2), **{n: count_tokens(F.col(c)).cast("double") for n, c in zip(names, DOMAIN_COLUMNS, strict=True)}, "nc1": (frame(1) == 2).cast("double"), "nc2": (frame(2) == 2).cast("double")}


def features(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(row, token, weight) of the text and numeric parts of rows with `row`."""
    cells = dict(zip(["r1", "l1", "r2", "l2"], (F.col(c) for c in DOMAIN_COLUMNS), strict=True))
    tokens = df.select("row", F.explode(side_tokens(cells, cfg.parity)).alias("token"))
    nums = numeric(df)
    long = df.select("row", F.explode(F.array(*(F.struct(F.lit(f"#{k}").alias("token"), v.alias("weight")) for k, v in nums.items()))).alias("x")).select("row", "x.token", "x.weight").filter("weight <> 0")
    return tfidf(tokens, cfg.tfidf_norm, not cfg.tfidf).union(long)


def neighbours(feats: DataFrame, k: int) -> DataFrame:
    """Symmetric cosine graph of each row's k nearest, exact at any size."""
    near, _ = sparse.cosine_lists(feats, k)
    return graph.symmetrise(near.select(F.col("row").alias("src"), F.col("other").alias("dst"), "w"))


def split_holdout(n: int, share: float = 0.2, seed: int = 34) -> tuple[list[int], list[int]]:
    """Row numbers 0..n-1 of training and holdout rows: a seeded shuffle, both parts in order again."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    cut = max(1, int(n * (1 - share)))
    return sorted(order[:cut]), sorted(order[cut:])


def _scored(events: DataFrame, known: DataFrame, cfg: Config) -> DataFrame:
    """(row, source, id, gene1, gene2, score) of all rows; known has the source positive, or holdout for what is held out."""
    table = numbered(known.unionByName(aligned(events, "event")), ["source", "id", "gene1", "gene2"], "row")
    table = stored(table, "score-table")
    k = max(1, min(cfg.neighbours, table.count() - 1))
    p = stored(graph.row_stochastic(neighbours(features(table, cfg), k)), "score-graph")
    seeds = table.select(F.col("row").alias("node"), (F.col("source") == "positive").cast("double").alias("y"))
    found = graph.rescale(graph.diffuse(p, seeds, cfg.alpha, cfg.max_iterations, cfg.tolerance))
    return table.join(found.select(F.col("node").alias("row"), "score"), "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _of(scored: DataFrame, source: str) -> DataFrame:
    return scored.filter(F.col("source") == source).select(F.col("id").try_cast("bigint").alias("id"), "gene1", "gene2", F.col("score").cast("float").alias("driver_score"))


def evaluate(events: DataFrame, positives: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of events when a share of the positives is held out, scores of those, and how well the ranking of all rows finds them."""
    known = aligned(positives, "positive")
    if cfg.parity:
        rows = stored(numbered(known, ["id", "gene1", "gene2"], "n"), "positives")
        test = known.sparkSession.createDataFrame([(i + 1, "holdout") for i in split_holdout(rows.count(), cfg.holdout, cfg.seed)[1]], "n long, part string")
        rows = rows.join(test, "n", "left")
    else:
        rows = shuffling.split(known, ["id", "gene1", "gene2"], cfg.holdout, cfg.seed, "n")
    known = rows.withColumn("source", F.when(F.col("part") == "holdout", "holdout").otherwise(F.col("source"))).drop("part", "n")
    scored = stored(_scored(events, known, cfg), "scored")
    ranks = graph.ranked(scored.select("row", "score", (F.col("source") == "holdout").cast("int").alias("relevant")), "score", "row")
    return _of(scored, "event"), _of(scored, "holdout"), graph.ranking_metrics(ranks, list(cfg.metric_ks))


def score(events: DataFrame, positives: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, gene1, gene2, driver_score) of the events."""
    return _of(_scored(events, aligned(positives, "positive"), cfg), "event")
