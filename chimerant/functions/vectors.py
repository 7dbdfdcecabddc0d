"""Column expressions over array<float> vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column, eps: float = 1e-12) -> Column:
    """The unit vector; the length is computed once for a vector, not once for an element."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(eps)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), 1)
