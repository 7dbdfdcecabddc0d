"""Set operators on tables and on set-valued cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def ordered_distinct(df: DataFrame, order: str) -> DataFrame:
    """Distinct rows (without the order column), each with its first place."""
    return df.groupBy(*[c for c in df.columns if c != order]).agg(F.min(order).alias(order))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def ordered_distinct_cell(df: DataFrame, by: list[str], value: str, order: list[str], separator: str = "|") -> DataFrame:
    """Distinct values of each key in order of first occurrence, as one cell."""
    first = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), separator).alias(f"{value}s"))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Sizes and similarities of two sets; similarities of empty sets are 0."""
    n_a, n_b, both, every = F.size(a), F.size(b), F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    share = lambda x, y: F.when(y > 0, x / F.greatest(y, F.lit(1)).cast("double")).otherwise(0.0)
    precision, recall = share(both, n_b), share(both, n_a)
    f1 = F.when(both > 0, 2 * precision * recall / F.when(both > 0, precision + recall)).otherwise(0.0)
    return {"n_a": n_a, "n_b": n_b, "n_intersection": both, "n_union": every, "precision": precision, "recall": recall, "f1": f1, "jaccard": share(both, every)}


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
