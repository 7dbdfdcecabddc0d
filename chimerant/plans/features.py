"""Feature flags of events: strand, UTRs, truncation, MANE, genes, domains lost, reading frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.functions.text import any_pattern
from chimerant.operators.joins import interval, lookup
from chimerant.operators.ranges import numbered
from chimerant.operators.windows import first_per_key

FLAGS = ["same_gene_fusion", "same_gene_fusion_lost_dom", "wrong_tr_dir_5p", "wrong_tr_dir_3p", "out_of_frame", *(f"lost_{c}_key_doms{s}" for c in ("kinases", "ts", "cancer", "actionable", "druggable") for s in (1, 2)), "truncated_5p", "truncated_3p", "promoter_hijacking_500", "promoter_hijacking_1000", "retained_5P_UTR1", "retained_3P_UTR1", "retained_5P_UTR2", "retained_3P_UTR2", "read_through"]
RENAMES = {"strand1": "gene_strand1", "strand2": "gene_strand2", "5_p_role": "5p_role", "3_p_role": "3p_role"}


def with_defaults(df: DataFrame) -> DataFrame:
    """Known other names, missing flags as 0 and an id."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})
    df = df.withColumns({c: F.lit(0) for c in FLAGS if c not in df.columns})
    return df if "id" in df.columns else numbered(df)


def strand_coherence(df: DataFrame) -> DataFrame:
    """1 if the fusion's strand is not the gene's, 2 if it is missing."""
    if not {"fusion_strand1", "gene_strand1", "fusion_strand2", "gene_strand2"} <= set(df.columns):
        return df
    code = lambda s: F.when(F.col(f"fusion_strand{s}") == ".", 2).when(F.col(f"fusion_strand{s}") != F.col(f"gene_strand{s}"), 1).otherwise(0)
    return df.withColumns({"wrong_tr_dir_5p": code(1), "wrong_tr_dir_3p": code(2)})


def _sided(df: DataFrame, side: int) -> bool:
    return {f"transcript_id{side}", f"breakpoint{side}", f"fusion_strand{side}"} <= set(df.columns)


def utr_bounds(features: DataFrame) -> DataFrame:
    """Per transcript what the UTR rules need: one row each, so joins never multiply events."""
    five, three = F.col("feature_type") == "five_prime_utr", F.col("feature_type") == "three_prime_utr"
    return features.filter(five | three).groupBy("transcript_id").agg(
        F.count_if(five).alias("_n5"), F.count_if(three).alias("_n3"), F.max("end").alias("_end"), F.min("start").alias("_start"), F.max(F.when(three, F.col("start"))).alias("_start3_max"), F.min(F.when(three, F.col("start"))).alias("_start3_min"),
    )


def utr_flags(df: DataFrame, features: DataFrame, parity: bool = True) -> DataFrame:
    """retained_*_UTR and truncated_*: one join per side.

    A UTR is kept if the breakpoint lies past all its rows. With parity, rows of the other kind of UTR count as not
    kept, so a transcript with both kinds keeps neither."""
    bounds = utr_bounds(features)
    for side in (s for s in (1, 2) if _sided(df, s)):
        bp, strand = F.col(f"breakpoint{side}"), F.col(f"fusion_strand{side}")
        df = df.join(bounds.withColumnRenamed("transcript_id", "_t"), F.col(f"transcript_id{side}") == F.col("_t"), "left")
        past = ((strand == "+") & (bp >= F.col("_end"))) | ((strand == "-") & (bp <= F.col("_start")))
        alone = lambda mine, other: past & (F.col(mine) > 0) & ((F.col(other) == 0) if parity else F.lit(True))
        cut = ((strand == "+") & (bp < F.col("_start3_max"))) | ((strand == "-") & (bp > F.col("_start3_min")))
        flag = lambda c: F.when(c, 1).otherwise(0)
        df = df.withColumns({f"retained_5P_UTR{side}": flag(alone("_n5", "_n3")), f"retained_3P_UTR{side}": flag(alone("_n3", "_n5")), f"truncated_{'5p' if side == 1 else '3p'}": flag(cut)})
        df = df.drop("_t", "_n5", "_n3", "_end", "_start", "_start3_max", "_start3_min")
    return df


def gene_ids(df: DataFrame, features: DataFrame) -> DataFrame:
    """gene_id1 and gene_id2 by transcript, where the columns are missing."""
    genes = features.select("transcript_id", "gene_id").dropna().distinct()
    for side in (1, 2):
        if f"gene_id{side}" not in df.columns:
            df = lookup(df, genes, f"transcript_id{side}", "transcript_id", {"gene_id": f"gene_id{side}"})
    return df


def mane(df: DataFrame, table: DataFrame) -> DataFrame:
    one = table.select("transcript_id", "mane_transcript_id", "mane_tss").distinct()
    for side in (1, 2):
        df = lookup(df, one, f"transcript_id{side}", "transcript_id", {"mane_transcript_id": f"mane{side}", "mane_tss": f"mane_tss{side}"})
    return df


def domains_lost(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Flags of each class and side: one alternation over the lost domains' names, gated by the partner's role.

    A class looks at the partner's role column where the table has it; else at all rows."""
    roles = {"kinases": "Kinases", "ts": "Suppressor", "cancer": "Cancer", "actionable": "Actionable", "druggable": "Druggable"}
    out = {}
    for name, patterns in cfg.classes.items():
        for side, role in ((1, "5p_role"), (2, "3p_role")):
            column = f"lost_domain_names{side}"
            hit = any_pattern(F.col(column), patterns) if column in df.columns else F.lit(False)
            if role in df.columns:
                hit = hit & F.coalesce(F.col(role).rlike(f"(?i){roles[name]}"), F.lit(False))
            out[f"lost_{name}_key_doms{side}"] = F.when(hit, 1).otherwise(0)
    return df.withColumns(out)


def frames(df: DataFrame, cds: DataFrame) -> DataFrame:
    """Reading frame at both breakpoints: an interval join per side, reduced to one row per event."""
    if "feature_type" in cds.columns:
        cds = cds.filter("feature_type = 'CDS'")
    for side in (1, 2):
        t, at, s = f"transcript_id{side}", f"breakpoint{side}", f"gene_strand{side}"
        if not {t, at} <= set(df.columns):
            df = df.withColumns({f"frame{side}": F.lit(None).cast("bigint"), f"coding_bp{side}": F.lit(False)})
            continue
        strand = F.coalesce(F.col(s), F.lit("+")) if s in df.columns else F.lit("+")
        hits = interval(df.select("id", t, at, strand.alias("_s")), cds, t, at, ["length", "cumulative_length"], "inner")
        inside = F.when(F.col("_s") == "+", F.col(at) - F.col("_start")).otherwise(F.col("_end") - F.col(at))
        found = hits.select("id", F.pmod(F.col("_cumulative_length") - F.col("_length") + inside, F.lit(3)).alias(f"frame{side}"), "_start", "_end")
        df = df.join(first_per_key(found, ["id"], [F.col("_start"), F.col("_end")]).select("id", f"frame{side}"), "id", "left").withColumn(f"coding_bp{side}", F.col(f"frame{side}").isNotNull())
    return pair_frames(df)


def pair_frames(df: DataFrame) -> DataFrame:
    """in_frame, out_of_frame_pair and each side's 0 (in frame), 1 (out of it) or 2 (a side is not coding)."""
    both = F.col("coding_bp1") & F.col("coding_bp2")
    df = df.withColumns({"in_frame": both & (F.col("frame1") == F.col("frame2")), "out_of_frame_pair": both & (F.col("frame1") != F.col("frame2"))})
    code = lambda s: F.when(~F.col(f"coding_bp{s}"), 2).when(F.col("out_of_frame_pair"), 1).when(F.col("in_frame"), 0).otherwise(2)
    return df.withColumns({f"out_of_frame{s}": code(s) for s in (1, 2)})


def compute(df: DataFrame, features: DataFrame, mane_table: DataFrame, cds: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All feature flags; no step multiplies rows."""
    steps = [with_defaults, strand_coherence, lambda d: utr_flags(d, features, cfg.parity), lambda d: gene_ids(d, features), lambda d: mane(d, mane_table), lambda d: domains_lost(d, cfg), lambda d: frames(d, cds)]
    return reduce(lambda d, f: f(d), steps, df)
