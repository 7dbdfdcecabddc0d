"""Reference tables from GTF and FASTA, each from one parsed scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerant.functions.text import unversioned
from chimerant.operators.windows import first_per_key, next_neighbour, signed
from chimerant.sources.tables import with_id


def all_features(gtf: DataFrame) -> DataFrame:
    return gtf.select("transcript_id", "gene_id", "feature_type", "strand", "chr", "start", "end")


def cds(gtf: DataFrame) -> DataFrame:
    """CDS segments with the running length in reading order."""
    rows = gtf.filter("feature_type = 'CDS'").withColumn("length", F.col("end") - F.col("start") + 1)
    order = signed(F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")), F.col("strand"))
    w = Window.partitionBy("transcript_id").orderBy(order, "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cumulative_length", F.sum("length").over(w))
    return rows.select("transcript_id", "strand", "start", "end", "length", "cumulative_length", F.floor(F.col("cumulative_length") / 3).alias("cumulative_length_aa"))


def mane(gtf: DataFrame) -> DataFrame:
    """One MANE transcript per gene, Select before Plus Clinical, with its TSS."""
    tagged = gtf.filter("feature_type = 'transcript'").withColumn("place", F.when(F.array_contains("tags", "MANE_Select"), 0).when(F.array_contains("tags", "MANE_Plus_Clinical"), 1)).filter("place IS NOT NULL")
    best = first_per_key(tagged, ["gene_id"], [F.col("place"), F.col("transcript_id")])
    return best.select("gene_id", "transcript_id", F.col("transcript_id").alias("mane_transcript_id"), F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("mane_tss"))


def next_gene(gtf: DataFrame) -> DataFrame:
    """Each gene's neighbour downstream on its chromosome and strand."""
    plus = F.col("strand") == "+"
    genes = gtf.filter("feature_type = 'gene'").select("gene_id", "chr", "strand", F.when(plus, F.col("start")).otherwise(F.col("end")).alias("tss"), F.when(plus, F.col("end")).otherwise(F.col("start")).alias("tes"))
    out = next_neighbour(genes, ["chr", "strand"], [signed(F.col("tss"), F.col("strand")), F.col("gene_id")], {"gene_id": "next_gene_id", "tss": "next_tss", "tes": "next_tes"})
    return out.dropna(subset=["next_gene_id"])


def gtf_lookups(gtf: DataFrame) -> dict[str, DataFrame]:
    return {"all_features_lookup": all_features(gtf), "cds_lookup": cds(gtf), "mane_lookup": mane(gtf), "next_gene_lookup": next_gene(gtf)}


#: The columns of each output of a FASTA file.
FASTA_OUTPUTS = {"peptide_lookup": ["transcript_id", "peptide_sequence", "protein_id"], "protein_lookup": ["protein_id", "peptide_sequence"], "clean_fasta": ["value"]}


def fasta_outputs(fasta: DataFrame) -> DataFrame:
    """(output, transcript_id, peptide_sequence, protein_id, value): the rows of all outputs, from one pass over the records."""
    rows = with_id(fasta).withColumn("transcript_id", F.nullif(unversioned(F.regexp_extract("header", r"transcript:(\S+)", 1)), F.lit(""))).filter("protein_id <> ''")
    cells = {"transcript_id": F.col("transcript_id"), "peptide_sequence": F.col("sequence"), "protein_id": F.col("protein_id"), "value": F.concat(F.lit(">"), "protein_id", F.lit("\n"), "sequence")}
    each = [F.struct(F.lit(name).alias("output"), *(cells[c].alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in cells)) for name, own in FASTA_OUTPUTS.items()]
    return rows.select(F.inline(F.array(*each))).filter("output <> 'peptide_lookup' OR transcript_id IS NOT NULL")


def fasta_lookups(fasta: DataFrame) -> dict[str, DataFrame]:
    """peptide_lookup by transcript, protein_lookup by protein and the clean records, each as a table."""
    tagged = fasta_outputs(fasta)
    return {name: tagged.filter(F.col("output") == name).select(*own) for name, own in FASTA_OUTPUTS.items()}
