"""Window operators: running sums, neighbours in signed order, preferred rows, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def next_neighbour(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """The named columns of the next row, by lead(); null on the last row of each partition."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({b: F.lead(a).over(w) for a, b in columns.items()})


def signed(position: Column, sign: Column, plus: str = "+") -> Column:
    """A position that orders upwards on the plus strand and downwards on the other."""
    return F.when(sign == plus, position).otherwise(-position)


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def runs(df: DataFrame, by: list[str], order: list[Column], starts: Column, out: str = "run") -> DataFrame:
    """Number of the run each row is in; `starts` says from the row alone or by lag whether a run begins there."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_s", starts.cast("int")).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def longest_run(df: DataFrame, by: list[str], run: str, position: str) -> DataFrame:
    """First position and length of the longest run of each key; the earliest wins a tie."""
    sized = df.groupBy(*by, run).agg(F.count(F.lit(1)).alias("length"), F.min(position).alias("start"))
    return first_per_key(sized, by, [F.desc("length"), F.col("start")])
