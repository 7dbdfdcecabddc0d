"""Agreement of two domain tables: one plan from join to rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import DOMAIN_COLUMNS
from chimerant.functions.text import accessions, joined
from chimerant.operators.sets import overlap


def rows(reference: DataFrame, found: DataFrame, id_col: str = "id", columns: list[str] = DOMAIN_COLUMNS) -> DataFrame:
    """Per id and column: both sets, what is missing or extra, precision, recall, F1 and Jaccard."""
    a = reference.select(F.col(id_col).cast("string").alias(id_col), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = found.select(F.col(id_col).cast("string").alias(id_col), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = a.join(b, id_col)
    long = both.selectExpr(id_col, f"stack({len(columns)}, {', '.join(f"'{c}', a_{c}, b_{c}" for c in columns)}) AS (col, a, b)")
    sets = long.select(id_col, "col", accessions(F.col("a")).alias("a"), accessions(F.col("b")).alias("b"))
    m = overlap(F.col("a"), F.col("b"))
    lost, extra = F.array_except("a", "b"), F.array_except("b", "a")
    return sets.select(
        id_col, "col", joined(F.col("a")).alias("iprs_interpro"), joined(F.col("b")).alias("iprs_faiss"), m["n_a"].alias("n_ipro"), m["n_b"].alias("n_faiss"), m["n_intersection"].alias("n_intersection"), m["n_union"].alias("n_union"),
        F.size(lost).alias("n_missing"), joined(lost).alias("missing_in_faiss"), F.size(extra).alias("n_extra"), joined(extra).alias("extra_in_faiss"), (F.size(lost) == 0).cast("int").alias("all_interpro_in_faiss"),
        *(F.bround(m[k], 6).alias(k) for k in ("precision", "recall", "f1", "jaccard")),
    )


def stats(found: DataFrame) -> DataFrame:
    """Per column and for all: rows, fully and partly covered ones, means."""
    full = F.col("all_interpro_in_faiss") == 1
    g = found.rollup("col").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("n_full_subset"), F.bround(F.avg(full.cast("int")) * 100, 2).alias("pct_full_subset"), F.count_if(~full).alias("n_partial_subset"),
        F.avg("n_missing").alias("mean_missing"), F.avg("n_extra").alias("mean_extra"), *(F.avg(c).alias(f"{c}_mean") for c in ("precision", "recall", "f1", "jaccard")),
    )
    return g.withColumn("col", F.coalesce("col", F.lit("ALL_COLUMNS")))
