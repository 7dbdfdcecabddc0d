"""Joins: lookups, intervals, additive unions of columns, adjacency, existence.

No side is broadcast by hint: sizes decide at run time (AQE), so a genome's lookup is broadcast and a larger one shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, left: str, right: str, columns: dict[str, str], default=None) -> DataFrame:
    """Left join of columns of a lookup (name there to name here), its key dropped; null results get `default`."""
    picked = table.select(F.col(right).alias("_key"), *(F.col(a).alias(b) for a, b in columns.items()))
    out = df.join(picked, F.col(left) == F.col("_key"), "left").drop("_key")
    return out if default is None else out.withColumns({b: F.coalesce(F.col(b), F.lit(default)) for b in columns.values()})


def interval(df: DataFrame, table: DataFrame, key: str, at: str, columns: list[str], how: str = "left", other: str = "transcript_id") -> DataFrame:
    """Rows of a table whose start..end holds a position of df with the same key: one equi-join with a range residual."""
    picked = table.select(F.col(other).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), *(F.col(c).alias(f"_{c}") for c in columns if c not in ("start", "end")))
    hit = (F.col(key) == F.col("_key")) & (F.col("_start") <= F.col(at)) & (F.col("_end") >= F.col(at))
    return df.join(picked, hit, how).drop("_key")


def additive(base: DataFrame, more: DataFrame, key: str = "id", prefer: str = "first") -> DataFrame:
    """base with the columns of `more` that it lacks; prefer="last" lets `more` replace those both have.

    Repeated keys in `more` are an error of the caller: check with is_unique()."""
    new = [c for c in more.columns if c != key and (c not in base.columns or prefer == "last")]
    kept = base.select(*[f"`{c}`" for c in base.columns if c not in new])
    # The base's columns keep their order, the key its place.
    return kept.join(more.select(key, *[f"`{c}`" for c in new]), key, "left").select(*[f"`{c}`" for c in [*kept.columns, *new]])


def is_unique(df: DataFrame, key: str = "id") -> bool:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def mark(df: DataFrame, ids: DataFrame, flag: str, value: int = 1, key: str = "id") -> DataFrame:
    """Set a flag where the key occurs in ids; made with 0 where the column is missing."""
    hit = ids.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    old = F.col(f"`{flag}`") if flag in df.columns else F.lit(0)
    return df.join(hit, F.col(key) == F.col("_key"), "left").withColumn(flag, F.when(F.col("_hit"), value).otherwise(old)).drop("_key", "_hit")


def exists(df: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    return df.join(other, condition, "left_semi")


def missing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")
