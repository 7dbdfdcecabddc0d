"""Breakpoints to residues: retained and lost parts of both partners' peptides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import MISSING
from chimerant.functions.text import codon, or_missing, prefix, residues, suffix
from chimerant.operators.joins import interval, lookup
from chimerant.operators.storage import stored
from chimerant.operators.ranges import numbered
from chimerant.operators.windows import first_per_key


def strand_column(df: DataFrame, side: int) -> str:
    for name in (f"gene_strand{side}", f"fusion_strand{side}"):
        if name in df.columns:
            return name
    raise ValueError(f"no strand column for side {side}")


def attach(df: DataFrame, peptides: DataFrame) -> DataFrame:
    """Both sides' peptides and proteins; the second protein is protein_id_right."""
    one = peptides.withColumn("peptide_sequence", residues(F.col("peptide_sequence")))
    out = lookup(df, one, "transcript_id1", "transcript_id", {"peptide_sequence": "peptide_sequence1", "protein_id": "protein_id"}, MISSING)
    return lookup(out, one, "transcript_id2", "transcript_id", {"peptide_sequence": "peptide_sequence2", "protein_id": "protein_id_right"}, MISSING)


def split(df: DataFrame, cds: DataFrame, side: int) -> DataFrame:
    """retained_peptide and lost_peptide of a side: the residues up to the breakpoint's, and those after it.

    Both are the placeholder without a CDS segment at the breakpoint; of overlapping segments the first counts."""
    at, strand = f"breakpoint{side}", F.col(strand_column(df, side))
    hits = interval(df.select("id", f"transcript_id{side}", at, strand.alias("_s")), cds, f"transcript_id{side}", at, ["length", "cumulative_length"], "inner")
    inside = F.when(F.col("_s") == "+", F.col(at) - F.col("_start")).otherwise(F.col("_end") - F.col(at))
    found = hits.withColumn("_aa", codon(F.col("_cumulative_length") - F.col("_length") + inside)).filter("_aa >= 0")
    found = first_per_key(found.select("id", "_aa", "_start", "_end"), ["id"], [F.col("_start"), F.col("_end")]).select("id", "_aa")
    whole = F.col(f"peptide_sequence{side}")
    out = df.join(found, "id", "left")
    parts = {f"retained_peptide{side}": prefix(whole, F.col("_aa")), f"lost_peptide{side}": suffix(whole, F.col("_aa"))}
    # At a stage's edge an empty part is null, so that it is told from a missing one.
    return out.withColumns({k: F.when(F.col("_aa").isNull(), MISSING).otherwise(F.nullif(v, F.lit(""))) for k, v in parts.items()}).drop("_aa")


def build(events: DataFrame, peptides: DataFrame, cds: DataFrame) -> DataFrame:
    """Events with ids, proteins and the four fragments."""
    df = events if "id" in events.columns else stored(numbered(events), "numbered")
    df = attach(df, peptides)
    for side in (1, 2):
        df = split(df, cds, side)
    return df.drop("peptide_sequence1", "peptide_sequence2").withColumns({c: or_missing(F.col(c)) for c in ("protein_id", "protein_id_right")})
