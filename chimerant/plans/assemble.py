"""The complete table of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chimerant.operators.joins import additive, is_unique

KEYS = ["gene1", "gene2", "transcript_id1", "transcript_id2", "chromosome1", "chromosome2", "breakpoint1", "breakpoint2"]


def complete(peptides: DataFrame, domains: DataFrame, features: DataFrame, annotated: DataFrame, scores: DataFrame, expression: DataFrame | None = None, prefer: str = "first") -> DataFrame:
    """Stage tables joined on id; a column belongs to the first stage that has it (prefer="last": to the last).

    Expression joins on eight keys, where missing values match nothing."""
    for name, df in (("peptides", peptides), ("domains", domains), ("features", features), ("annotated", annotated), ("scores", scores)):
        if not is_unique(df):
            raise ValueError(f"ids of {name} are not unique")
    out = additive(peptides, domains, prefer=prefer)
    if expression is not None:
        out = out.join(expression.dropDuplicates(KEYS), KEYS, "left")
        out = out.select(*[f"`{c}`" for c in [*peptides.columns, *(c for c in out.columns if c not in peptides.columns)]])
    for more in (features, annotated, scores):
        out = additive(out, more, prefer=prefer)
    return out
