"""A whole run: each stage's table is written to the shared folder and read again, so no stage plans over those before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from chimerant.config import Config
from chimerant.operators.storage import stored
from chimerant.plans import assemble, events, features, peptides, retrieval, scoring


@dataclass
class Result:
    complete: DataFrame
    counts: DataFrame
    peptides: DataFrame
    annotated: DataFrame
    scores: DataFrame


def run(table: DataFrame, lookups: dict[str, DataFrame], positives: DataFrame, retrieve=None, index: DataFrame | None = None, embedder: retrieval.Embedder | None = None, expression: DataFrame | None = None, cfg: Config = Config()) -> Result:
    """table: events; lookups: peptide_lookup, cds_lookup, all_features_lookup, mane_lookup, next_gene_lookup.

    retrieve: takes the peptide table and returns it with domain columns; by default vector search in `index`."""
    pep = stored(peptides.build(table, lookups["peptide_lookup"], lookups["cds_lookup"]), "peptides")
    domains = stored(retrieve(pep) if retrieve else retrieval.by_search(pep, index, embedder or retrieval.kmer_embedder(), cfg), "domains")
    feats = stored(features.compute(domains, lookups["all_features_lookup"], lookups["mane_lookup"], lookups["cds_lookup"], cfg), "features")
    noted = stored(events.annotate(feats, lookups["all_features_lookup"], lookups["next_gene_lookup"], cfg, expression), "annotated")
    scores = stored(scoring.score(noted, positives, cfg), "scores")
    whole = assemble.complete(pep, domains, feats, noted, scores, expression, "first" if cfg.parity else "last")
    return Result(whole, events.counts(noted, cfg), pep, noted, scores)
