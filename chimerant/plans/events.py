"""Event rules and their counts; every rule is an inline column, each lookup joins once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerant.config import MISSING, Config
from chimerant.operators.joins import lookup
from chimerant.operators.sets import any_of
from chimerant.operators.windows import first_per_key
from chimerant.plans.features import gene_ids

COUNTED = ["promoter_hijacking_500", "promoter_hijacking_1000", "read_through", "read_through_loose", "same_gene_fusion"]


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


def _ever(df: DataFrame, name: str, c: Column) -> Column:
    """The flag is set by the rule and stays set where it was."""
    return F.greatest(F.coalesce(F.col(name).cast("int"), F.lit(0)), _flag(c)) if name in df.columns else _flag(c)


def same_gene(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: F.lit(MISSING) for c in ("lost_domains1", "lost_domains2") if c not in df.columns})
    same = F.col("gene1") == F.col("gene2")
    lost = (F.col("lost_domains1") != MISSING) | (F.col("lost_domains2") != MISSING)
    return df.withColumns({"same_gene_fusion": _ever(df, "same_gene_fusion", same), "same_gene_fusion_lost_dom": _ever(df, "same_gene_fusion_lost_dom", same & lost)})


def transcripts(features: DataFrame) -> DataFrame:
    """One row per transcript: its ends by strand and where its CDS begins."""
    plus = F.col("strand") == "+"
    tx = first_per_key(features.filter("feature_type = 'transcript'"), ["transcript_id"], [F.col("start"), F.col("end")])
    tx = tx.select("transcript_id", F.col("strand").alias("t_strand"), F.when(plus, F.col("start")).otherwise(F.col("end")).alias("t_tss"), F.when(plus, F.col("end")).otherwise(F.col("start")).alias("t_tes"))
    begin = features.filter("feature_type = 'CDS'").groupBy("transcript_id", "strand").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    begin = first_per_key(begin, ["transcript_id"], [F.col("strand")]).select("transcript_id", F.when(plus, F.col("lo")).otherwise(F.col("hi")).alias("t_cds"))
    return tx.join(begin, "transcript_id", "left")


def promoter_hijacking(df: DataFrame, features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The first breakpoint lies upstream of its transcript's TSS, or between TSS and CDS."""
    j = lookup(df, transcripts(features), "transcript_id1", "transcript_id", {"t_strand": "_s", "t_tss": "_tss", "t_cds": "_cds"})
    bp = F.col("breakpoint1").try_cast("bigint")
    plus = F.col("_s") == "+"
    up = F.when(plus, F.col("_tss") - bp).otherwise(bp - F.col("_tss"))
    within = lambda w: (up > 0) & (up <= w)
    utr = F.when(plus, (bp >= F.col("_tss")) & (bp < F.col("_cds"))).otherwise((bp <= F.col("_tss")) & (bp > F.col("_cds")))
    rules = {"promoter_hijacking_prom": within(cfg.promoter_window), "promoter_hijacking_utr": utr, "promoter_hijacking": F.coalesce(within(cfg.promoter_window), F.lit(False)) | F.coalesce(utr, F.lit(False)), "promoter_hijacking_500": within(cfg.promoter_500), "promoter_hijacking_1000": within(cfg.promoter_1000)}
    return j.withColumns({k: _ever(df, k, c) for k, c in rules.items()}).drop("_s", "_tss", "_cds")


def read_through(df: DataFrame, adjacency: DataFrame, features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Strict and loose read-through by one join with the adjacency table and one per side with transcripts.

    Strict: gene 2 is next to gene 1 and the breakpoints are near each other. Loose: the genes' ends are, and both
    breakpoints are near them."""
    df = gene_ids(df, features)
    adj = first_per_key(adjacency, ["gene_id", "chr", "strand"], [F.col("next_gene_id")]).select("gene_id", "chr", "strand", "next_gene_id", F.col("tes").alias("_tes"), F.col("next_tss").alias("_next"))
    on = (F.col("gene_id1") == F.col("gene_id")) & (F.col("chromosome1").cast("string") == F.col("chr").cast("string")) & (F.col("gene_strand1") == F.col("strand"))
    j = df.join(adj, on, "left").drop("gene_id", "chr", "strand")
    tx = transcripts(features)
    if cfg.transcript_anchors:
        j = lookup(j, tx, "transcript_id1", "transcript_id", {"t_tes": "_a1"})
        j = lookup(j, tx, "transcript_id2", "transcript_id", {"t_tss": "_a2"})
    else:
        j = j.withColumns({"_a1": F.col("_tes"), "_a2": F.col("_next")})
    a1, a2 = F.col("_a1").try_cast("bigint"), F.col("_a2").try_cast("bigint")
    bp1, bp2 = F.col("breakpoint1").try_cast("bigint"), F.col("breakpoint2").try_cast("bigint")
    subsequent = (F.col("chromosome1").cast("string") == F.col("chromosome2").cast("string")) & (F.col("gene_strand1") == F.col("gene_strand2")) & (F.col("gene_id2") == F.col("next_gene_id"))
    strict = subsequent & (F.abs(bp2 - bp1) <= cfg.read_through_gap)
    w = cfg.breakpoint_window
    loose = subsequent & (F.abs(a2 - a1) <= cfg.gene_gap) & bp1.between(a1 - w, a1 + w) & bp2.between(a2 - w, a2 + w)
    if cfg.promote_loose:
        strict = F.coalesce(strict, F.lit(False)) | F.coalesce(loose, F.lit(False))
    return j.withColumns({"read_through": _ever(df, "read_through", strict), "read_through_loose": _ever(df, "read_through_loose", loose)}).drop("next_gene_id", "_tes", "_next", "_a1", "_a2")


def true_fusions(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per threshold: both coverages above it, and no other event explains the fusion."""
    df = df.withColumns({c: F.lit(0.0) for c in ("coverage1", "coverage2") if c not in df.columns})
    others = ["same_gene_fusion", "read_through", "promoter_hijacking_500", "promoter_hijacking_1000"]
    df = df.withColumns({c: F.lit(0) for c in others if c not in df.columns})
    free = ~any_of([F.col(c) != 0 for c in others])
    return df.withColumns({f"true_fusion_{t}": _flag(free & (F.col("coverage1") > t) & (F.col("coverage2") > t)) for t in cfg.coverage_thresholds})


def counts(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(type, count) in fixed order, with `none` for rows without any of the flags: one aggregate, then unpivot."""
    names = [c for c in [*(f"true_fusion_{t}" for t in cfg.coverage_thresholds), *COUNTED] if c in df.columns]
    at = lambda c: F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))
    one = df.agg(*(F.count_if(at(c)).alias(f"n{i}") for i, c in enumerate(names)), F.count_if(~any_of([at(c) for c in names])).alias(f"n{len(names)}"))
    rows = ", ".join(f"{i}, '{c}', n{i}" for i, c in enumerate([*names, "none"]))
    return one.selectExpr(f"stack({len(names) + 1}, {rows}) AS (place, type, count)").orderBy("place").drop("place")


def annotate(df: DataFrame, features: DataFrame, adjacency: DataFrame, cfg: Config = Config(), coverage: DataFrame | None = None) -> DataFrame:
    """All event flags. With a coverage table (and cfg.parity off) it is joined first, so that true fusions can be found."""
    if coverage is not None and not cfg.parity:
        from chimerant.plans.assemble import KEYS

        df = df.join(coverage.select(*KEYS, "coverage1", "coverage2"), KEYS, "left")
    for step in (same_gene, lambda d: promoter_hijacking(d, features, cfg), lambda d: read_through(d, adjacency, features, cfg), lambda d: true_fusions(d, cfg)):
        df = step(df)
    return df
