"""Every threshold of the engine, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field

# Domain names whose loss is looked for, by class. They are matched as regular expressions.
KINASE_DOMAINS = ["Protein kinase domain", "Serine/threonine-protein kinase domain", "Tyrosine-protein kinase domain", "Protein kinase ATP-binding region signature", "Protein kinase active site", "Activation loop of protein kinases"]
TUMOUR_SUPPRESSOR_DOMAINS = ["p53 DNA-binding domain", "DNA-binding domain of tumor suppressor p53", "Retinoblastoma-associated protein, pocket domain", "PTEN-like phosphatase domain", "Protein tyrosine phosphatase, non-receptor type", "BRCT domain"]
CANCER_DOMAINS = ["Protein kinase domain", "Small GTP-binding protein domain", "Ras-like small GTPase domain", "Homeobox domain", "bZIP transcription factor, basic region", "Helix-turn-helix DNA-binding domain", "Forkhead (FOX) DNA-binding domain", "Nuclear hormone receptor, ligand-binding domain"]
ACTIONABLE_DOMAINS = ["Protein kinase domain", "Immunoglobulin-like domain", "Fibronectin type III domain", "Epidermal growth factor-like domain", "Transmembrane receptor protein tyrosine kinase domain", "G protein-coupled receptor, rhodopsin-like, 7TM domain", "Nuclear hormone receptor, ligand-binding domain", "Ion transport domain", "Voltage-gated potassium channel, pore region"]
DRUGGABLE_DOMAINS = ["Protein kinase domain", "G protein-coupled receptor, rhodopsin-like, 7TM domain", "Nuclear hormone receptor, ligand-binding domain", "Ion transport domain", "Serine protease domain", "Cysteine protease domain", "Metalloprotease catalytic domain", "Protein tyrosine phosphatase domain", "Immunoglobulin-like domain", "Fibronectin type III domain", "Epidermal growth factor-like domain"]
# Texts that stand for a missing value, columns that stay text, columns an event table must have.
NULL_TOKENS = ["", "NA", "na", "null", "Null", "N/A", "None"]
MISSING = "."
TEXT_COLUMNS = ["chr", "chrom", "chromosome", "chromosome1", "chromosome2"]
EVENT_COLUMNS = ["gene1", "gene2", "transcript_id1", "transcript_id2", "chromosome1", "chromosome2", "breakpoint1", "breakpoint2"]
DOMAIN_COLUMNS = ["retained_domains1", "lost_domains1", "retained_domains2", "lost_domains2"]
# Name parts that a stage puts after an input's name.
STAGE_TAGS = {"peptides", "faiss", "ips", "ips_only", "ips_full", "domains", "domains_full", "features", "annotated", "scores", "final"}


@dataclass(frozen=True)
class Config:
    # domain retrieval
    top_raw: int = 256
    top_unique: int = 8
    very_long: int = 1500
    window_size: int = 1200
    window_step: int = 800
    search_block: int = 2048
    batch_short: int = 32
    batch_long: int = 8
    long_cut: int = 900
    budget_short: int = 8000
    budget_long: int = 6000
    # index construction
    chunks: int = 32
    require_accession: bool = True
    min_length: int = 30
    max_length: int = 600
    context_left: int = 32
    context_right: int = 32
    metric: str = "ip"
    # expression
    signal_gray: int = 171
    gray_tolerance: int = 40
    max_pixels: int = 84
    coverage_thresholds: tuple[float, ...] = (1.5, 1.6, 1.8, 2.0, 2.5, 3.0)
    # events
    read_through_gap: int = 10_000
    gene_gap: int = 20_000
    breakpoint_window: int = 1_000
    transcript_anchors: bool = True
    promote_loose: bool = False
    promoter_500: int = 500
    promoter_1000: int = 1_000
    promoter_window: int = 1_500
    # scoring
    tfidf: bool = True
    tfidf_norm: str = "l2"
    neighbours: int = 20
    alpha: float = 0.9
    max_iterations: int = 100
    tolerance: float = 1e-6
    metric_ks: tuple[int, ...] = (10, 50, 100)
    holdout: float = 0.2
    seed: int = 34
    #: Behave as the published runs do where documentation and runs differ (see README).
    parity: bool = True
    classes: dict[str, list[str]] = field(default_factory=lambda: {"kinases": KINASE_DOMAINS, "ts": TUMOUR_SUPPRESSOR_DOMAINS, "cancer": CANCER_DOMAINS, "actionable": ACTIONABLE_DOMAINS, "druggable": DRUGGABLE_DOMAINS})
