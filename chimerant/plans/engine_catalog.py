"""The engine's own rules as queries: each calls a plan or a reader on tables made from the synthetic ones.

MADE holds the inputs, in SQL that Spark and DuckDB both read; what a query does with them is written twice, by the
engine's functions and, apart from them, as SQL. Columns start_ and end_ are start and end, which SQL reserves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import DOMAIN_COLUMNS, Config
from chimerant.functions import text as tx
from chimerant.operators.ranges import numbered
from chimerant.operators.storage import shared_folder
from chimerant.plans import assemble, comparison, embedding, events, expression, features, lookups, peptides, raster, retrieval, scoring
from chimerant.plans.catalog import QUERIES, SQL, Tables, until_converged
from chimerant.sources import matrix, tables, writers
from chimerant.sources.writers import FRAGMENTS
from chimerant.streaming import intake

CFG = Config()
STRAND = "CASE WHEN {} % 2 = 0 THEN '+' ELSE '-' END"
MADE = {
    # Events: every second one goes to the next gene; breakpoints lie inside the gene or upstream of it.
    "ev": f"""SELECT k AS id, 'G' || CAST(k % 7 AS STRING) AS gene1, 'G' || CAST(c % 7 AS STRING) AS gene2, k AS transcript_id1, t2 AS transcript_id2, CAST(k % 3 AS STRING) AS chromosome1, CAST(CASE WHEN c % 5 = 0 THEN 9 ELSE t2 % 3 END AS STRING) AS chromosome2,
k * 500 + (c * 13) % 440 + (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (CASE WHEN c % 10 < 3 THEN (c * 37) % 1700 ELSE 0 END) AS breakpoint1, t2 * 500 + (c * 7) % 400 + (CASE WHEN c % 9 = 0 THEN 20000 ELSE 0 END) AS breakpoint2,
{STRAND.format('k')} AS gene_strand1, {STRAND.format('t2')} AS gene_strand2, CASE c % 11 WHEN 0 THEN '.' WHEN 1 THEN '-' WHEN 2 THEN NULL ELSE {STRAND.format('k')} END AS fusion_strand1, CASE c % 13 WHEN 0 THEN '.' WHEN 1 THEN '+' WHEN 2 THEN NULL ELSE {STRAND.format('t2')} END AS fusion_strand2,
CASE k % 6 WHEN 0 THEN 'Protein kinase domain' WHEN 1 THEN 'BRCT domain' WHEN 2 THEN 'Homeobox domain|Ion transport domain' WHEN 3 THEN '.' WHEN 4 THEN NULL ELSE 'Zinc finger' END AS lost_domain_names1, CASE c % 5 WHEN 0 THEN 'Ion transport domain' WHEN 1 THEN 'PTEN-like phosphatase domain' WHEN 2 THEN '.' WHEN 3 THEN 'Protein kinase domain' END AS lost_domain_names2,
CASE k % 3 WHEN 0 THEN '.' ELSE 'IPR000001' END AS lost_domains1, CASE c % 4 WHEN 0 THEN 'IPR000002' ELSE '.' END AS lost_domains2, CASE k % 5 WHEN 0 THEN 'Kinases' WHEN 1 THEN 'tumour suppressor' WHEN 2 THEN 'Cancer, actionable' WHEN 3 THEN 'Druggable kinases' END AS role5, CASE c % 4 WHEN 0 THEN 'Druggable' WHEN 1 THEN 'KINASES' WHEN 2 THEN 'suppressor, cancer, actionable' END AS role3,
(k % 50) / 10.0E0 AS coverage1, (c % 50) / 10.0E0 AS coverage2
FROM (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE -6 END ELSE o_custkey END AS t2 FROM {{orders}}) AS o""",
    # Features: a gene and a transcript per order, UTRs of some, coding segments from the order's lines.
    "gtf": f"""WITH base AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey * 500 AS lo, {STRAND.format('o_orderkey')} AS strand, CAST(o_orderkey % 3 AS STRING) AS chr FROM {{orders}})
SELECT CAST(NULL AS BIGINT) AS transcript_id, k AS gene_id, 'gene' AS feature_type, strand, chr, lo AS start_, lo + 400 AS end_, '' AS tags FROM base
UNION ALL SELECT k, k, 'transcript', strand, chr, lo + c % 20, lo + 380, CASE WHEN k % 4 = 0 THEN 'basic,MANE_Select' WHEN k % 4 = 1 THEN 'MANE_Plus_Clinical' ELSE 'basic' END FROM base
UNION ALL SELECT k, k, 'five_prime_utr', strand, chr, CASE WHEN strand = '+' THEN lo + c % 20 ELSE lo + 350 END, CASE WHEN strand = '+' THEN lo + 30 ELSE lo + 380 END, '' FROM base WHERE c % 3 = 0
UNION ALL SELECT k, k, 'three_prime_utr', strand, chr, CASE WHEN strand = '+' THEN lo + 340 ELSE lo END, CASE WHEN strand = '+' THEN lo + 380 ELSE lo + 25 END, '' FROM base WHERE c % 4 < 2
UNION ALL SELECT DISTINCT l_orderkey, l_orderkey, 'CDS', {STRAND.format('l_orderkey')}, CAST(l_orderkey % 3 AS STRING), l_orderkey * 500 + 40 + l_linenumber * 45, l_orderkey * 500 + 40 + l_linenumber * 45 + CAST(l_quantity AS BIGINT), '' FROM {{lineitem}}""",
    # Several transcripts of one gene.
    "tx_by_gene": "SELECT o_orderkey AS transcript_id, o_custkey AS gene_id, 'transcript' AS feature_type, " + STRAND.format("o_orderkey") + " AS strand, '1' AS chr, o_orderkey * 10 AS start_, o_orderkey * 10 + 9 AS end_, CASE o_orderkey % 3 WHEN 0 THEN 'basic,MANE_Select' WHEN 1 THEN 'MANE_Plus_Clinical' ELSE 'basic' END AS tags FROM {orders}",
    "pep": "SELECT o_orderkey AS transcript_id, repeat('MK*QL', CAST(o_custkey % 30 + 1 AS INT)) || 'W\"' AS peptide_sequence, 'P' || CAST(o_orderkey AS STRING) AS protein_id FROM {orders} WHERE o_orderkey % 7 <> 3",
    "dom_a": "SELECT o_orderkey AS id, 'IPR00000' || CAST(o_orderkey % 5 AS STRING) || '|IPR00000' || CAST(o_custkey % 5 AS STRING) || ', junk' AS retained_domains1, CASE WHEN o_custkey % 3 = 0 THEN '.' ELSE 'IPR000007 | .' END AS lost_domains1, CASE WHEN o_custkey % 4 > 0 THEN 'IPR000001,IPR000002,IPR00000' || CAST(o_orderkey % 3 AS STRING) END AS retained_domains2, '' AS lost_domains2 FROM {orders}",
    "dom_b": "SELECT o_orderkey AS id, 'IPR000001|IPR000002| IPR000003' AS retained_domains1, CASE WHEN o_orderkey % 2 = 0 THEN 'IPR000007' ELSE 'IPR000008|IPR7' END AS lost_domains1, 'IPR000002' AS retained_domains2, CASE WHEN o_custkey % 5 = 0 THEN '.' ELSE 'IPR000004' END AS lost_domains2 FROM {orders} WHERE o_orderkey % 9 <> 0",
    "pixels": "SELECT CAST(o_orderkey - o_orderkey % 200 AS STRING) AS page_id, CAST(CASE WHEN o_orderkey % 200 < 100 THEN 1 ELSE 2 END AS INT) AS side, CASE WHEN o_orderkey % 100 < 50 THEN 'L' ELSE 'R' END AS half, CAST(o_orderkey % 50 AS INT) AS x, o_custkey % 4 <> 0 AS bottom, CAST(o_custkey % 85 AS INT) AS height FROM {orders}",
    # Multiples of the page height keep reads whole, so that their sums don't depend on the order of adding.
    "heights": "SELECT DISTINCT CAST(o_orderkey - o_orderkey % 200 AS STRING) AS page_id, CAST((o_orderkey - o_orderkey % 200) % 7 * 84 AS INT) AS max_height FROM {orders} WHERE (o_orderkey - o_orderkey % 200) % 11 <> 0",
    "exon_rows": "SELECT CAST(o_custkey AS STRING) AS page_id, CAST(o_orderkey % 2 + 1 AS INT) AS side, CASE WHEN o_orderkey % 3 = 0 THEN 'L' ELSE 'R' END AS half, CAST(o_orderkey % 41 AS DOUBLE) AS mean, CAST(o_orderkey % 37 AS DOUBLE) AS median FROM {orders}",
    "sheets": "SELECT CAST(c_custkey AS STRING) AS page_id, " + STRAND.format("c_custkey") + " AS strand1, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '+' ELSE '-' END AS strand2, CASE WHEN c_custkey % 7 > 0 THEN 'T' END AS transcript_id1, 'U' AS transcript_id2 FROM {customer}",
    "hits": "SELECT 'P' || CAST(l_orderkey AS STRING) || '.1' AS protein_id, CAST(l_linenumber * 20 - 15 AS BIGINT) AS start_, l_linenumber * 20 - 15 + CAST(l_quantity * 3 AS BIGINT) AS end_, CASE WHEN l_partkey % 3 > 0 THEN 'PF' || CAST(l_partkey % 9 AS STRING) END AS signature_accession, CASE l_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN NULL ELSE 'IPR00001' || CAST(l_suppkey % 10 AS STRING) END AS ipr_id, 'd' AS ipr_desc, 'A' AS analysis FROM {lineitem}",
    "proteins": "SELECT 'P' || CAST(o_orderkey AS STRING) AS protein_id, repeat('ACDEFGHIKL', CAST(o_custkey % 20 + 4 AS INT)) AS sequence FROM {orders} WHERE o_orderkey % 5 <> 2",
    "frag": "SELECT c_custkey AS id, repeat('A', CAST(c_custkey % 9 + 1 AS INT)) || repeat('C', CAST(c_custkey % 7 AS INT)) AS retained_peptide1, repeat('C', CAST(c_custkey % 5 + 1 AS INT)) || repeat('D', CAST(c_custkey % 11 AS INT)) AS lost_peptide1, repeat('AD', CAST(c_custkey % 4 + 1 AS INT)) AS retained_peptide2, CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE 'ACD' END AS lost_peptide2 FROM {customer}",
    # Fusions of few kinds: cells of one to three domains, frames, and every fifth a known driver.
    "fused": "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'positive' ELSE 'event' END AS source, 'A' || CAST(c_custkey % 37 AS STRING) AS gene1, 'B' || CAST(c_custkey % 41 AS STRING) AS gene2, CASE c_custkey % 4 WHEN 0 THEN 'IPR' || CAST(c_nationkey AS STRING) WHEN 1 THEN 'IPR' || CAST(c_nationkey % 7 AS STRING) || '|IPR' || CAST(c_custkey % 11 AS STRING) WHEN 2 THEN ' IPR' || CAST(c_custkey % 13 AS STRING) || ' | kin ase|' ELSE '.' END AS retained_domains1, CASE WHEN c_custkey % 3 = 0 THEN 'IPR' || CAST(c_custkey % 17 AS STRING) END AS lost_domains1, CASE WHEN c_custkey % 7 < 4 THEN 'IPR1|IPR' || CAST(c_custkey % 19 AS STRING) || '|IPR' || CAST(c_nationkey AS STRING) ELSE '' END AS retained_domains2, CASE c_custkey % 6 WHEN 0 THEN 'IPR9' WHEN 1 THEN 'IPR9|IPR8' ELSE '.' END AS lost_domains2, CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0.0' WHEN 3 THEN 'x' END AS out_of_frame1, CASE WHEN c_nationkey % 3 = 0 THEN '1' ELSE '0' END AS out_of_frame2 FROM {customer}",
    "parts": "SELECT s_suppkey AS pos, 'IPR' || CAST(s_suppkey % 23 AS STRING) AS ipr_id, CASE WHEN s_suppkey % 23 % 3 > 0 THEN 'n' || CAST(s_suppkey % 23 AS STRING) ELSE ' ' END AS ipr_name, CAST(s_suppkey * 7 % 10 AS FLOAT) AS v1, CAST(s_suppkey * 3 % 8 AS FLOAT) AS v2, CAST(s_suppkey * 5 % 9 AS FLOAT) AS v3 FROM {supplier}",
}
NAMES = ["orders", "lineitem", "customer", "supplier"]


def made(t: Tables, name: str) -> DataFrame:
    used = [n for n in NAMES if "{" + n + "}" in MADE[name]]
    df = t.spark.sql(MADE[name], **{n: getattr(t, n) for n in used})
    return df.withColumnsRenamed({"start_": "start", "end_": "end", "role5": "5p_role", "role3": "3p_role"})


def annotation(t: Tables, name: str = "gtf") -> DataFrame:
    return made(t, name).withColumn("tags", F.split("tags", ","))


def query(body: str, *names: str):
    """Registers a query with its SQL: the inputs it names, then the body."""
    ctes = [f"{n} AS ({MADE[n].format(**{x: x for x in NAMES})})" for n in names]

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {'RECURSIVE ' * ('it AS (' in body)}{', '.join(ctes)}{body}"
        return f

    return put


def half_even(x: str, digits: int) -> str:
    """SQL of a number from 0 on, rounded half to even by its shortest decimal form, as bround() does."""
    i, unit = f"CAST(replace(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)) AS VARCHAR), '.', '') AS HUGEINT)", 10 ** (18 - digits)
    return f"CAST(({i} // {unit} + CASE WHEN {i} % {unit} > {unit // 2} OR ({i} % {unit} = {unit // 2} AND {i} // {unit} % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE) / 1e{digits}"


def flag(x: str, name: str) -> str:
    return f"CAST(coalesce({x}, false) AS INT) AS {name}"


@query(" SELECT id, CASE WHEN fusion_strand1 = '.' THEN 2 WHEN fusion_strand1 <> gene_strand1 THEN 1 ELSE 0 END AS wrong_tr_dir_5p, CASE WHEN fusion_strand2 = '.' THEN 2 WHEN fusion_strand2 <> gene_strand2 THEN 1 ELSE 0 END AS wrong_tr_dir_3p FROM ev", "ev")
def strand_coherence(spark, sf_dir):
    """DOM-06, PRJ-03, PRJ-05, PRJ-06."""
    df = features.with_defaults(made(Tables(spark, sf_dir), "ev").withColumnsRenamed({"gene_strand1": "strand1", "gene_strand2": "strand2"}))
    return features.strand_coherence(df).select("id", "wrong_tr_dir_5p", "wrong_tr_dir_3p")


def _utr_sql(s: int) -> str:
    kept = lambda kind: f"coalesce(min(CASE WHEN feature_type = '{kind}' AND ((fusion_strand{s} = '+' AND breakpoint{s} >= end_) OR (fusion_strand{s} = '-' AND breakpoint{s} <= start_)) THEN 1 ELSE 0 END), 0)"
    cut = f"coalesce(max(CASE WHEN feature_type = 'three_prime_utr' AND ((fusion_strand{s} = '+' AND breakpoint{s} < start_) OR (fusion_strand{s} = '-' AND breakpoint{s} > start_)) THEN 1 ELSE 0 END), 0)"
    return f"u{s} AS (SELECT id, {kept('five_prime_utr')} AS retained_5P_UTR{s}, {kept('three_prime_utr')} AS retained_3P_UTR{s}, {cut} AS truncated_{'53'[s - 1]}p FROM ev LEFT JOIN (SELECT * FROM gtf WHERE feature_type LIKE '%utr') g ON transcript_id{s} = transcript_id GROUP BY id)"


@query(f", {_utr_sql(1)}, {_utr_sql(2)} SELECT * FROM u1 JOIN u2 USING (id)", "ev", "gtf")
def utr_retention(spark, sf_dir):
    """DOM-07, DOM-08, JN-08, AGG-01."""
    t = Tables(spark, sf_dir)
    names = [f"{c}{s}" for s in (1, 2) for c in ("retained_5P_UTR", "retained_3P_UTR")]
    return features.utr_flags(made(t, "ev"), annotation(t)).select("id", *names, "truncated_5p", "truncated_3p")


MANE_SQL = ", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY CASE WHEN tags LIKE '%MANE_Select%' THEN 0 ELSE 1 END, transcript_id) AS n FROM tx_by_gene WHERE tags LIKE '%MANE%') WHERE n = 1), mane AS (SELECT gene_id, transcript_id, transcript_id AS mane_transcript_id, CASE WHEN strand = '+' THEN start_ ELSE end_ END AS mane_tss FROM m)"


@query(MANE_SQL + " SELECT * FROM mane", "tx_by_gene")
def mane_lookup(spark, sf_dir):
    """DOM-20: one MANE transcript per gene."""
    return lookups.mane(annotation(Tables(spark, sf_dir), "tx_by_gene"))


@query(MANE_SQL + ", g AS (SELECT DISTINCT transcript_id, gene_id FROM tx_by_gene) SELECT id, a.mane_transcript_id AS mane1, b.mane_transcript_id AS mane2, a.mane_tss AS mane_tss1, b.mane_tss AS mane_tss2, x.gene_id AS gene_id1, y.gene_id AS gene_id2 FROM ev LEFT JOIN mane a ON transcript_id1 = a.transcript_id LEFT JOIN mane b ON transcript_id2 = b.transcript_id LEFT JOIN g x ON transcript_id1 = x.transcript_id LEFT JOIN g y ON transcript_id2 = y.transcript_id", "ev", "tx_by_gene")
def mane_match(spark, sf_dir):
    """DOM-09, DOM-10."""
    t = Tables(spark, sf_dir)
    tx = annotation(t, "tx_by_gene")
    df = features.gene_ids(features.mane(made(t, "ev"), lookups.mane(tx)), tx)
    return df.select("id", "mane1", "mane2", "mane_tss1", "mane_tss2", "gene_id1", "gene_id2")


ROLES = {"kinases": "kinases", "ts": "suppressor", "cancer": "cancer", "actionable": "actionable", "druggable": "druggable"}


@query(" SELECT id, " + ", ".join(flag(f"regexp_matches(lost_domain_names{s}, '{'|'.join(CFG.classes[c])}') AND lower(role{r}) LIKE '%{role}%'", f"lost_{c}_key_doms{s}") for c, role in ROLES.items() for s, r in ((1, 5), (2, 3))) + " FROM ev", "ev")
def domain_loss(spark, sf_dir):
    """DOM-11, FLT-11."""
    return features.domains_lost(made(Tables(spark, sf_dir), "ev")).select("id", *(f"lost_{c}_key_doms{s}" for c in ROLES for s in (1, 2)))


@query(f" SELECT id, {flag('gene1 = gene2', 'same_gene_fusion')}, " + flag("gene1 = gene2 AND (lost_domains1 <> '.' OR lost_domains2 <> '.')", "same_gene_fusion_lost_dom") + " FROM ev", "ev")
def same_gene(spark, sf_dir):
    """DOM-13."""
    return events.same_gene(made(Tables(spark, sf_dir), "ev")).select("id", "same_gene_fusion", "same_gene_fusion_lost_dom")


TX_SQL = ", tx AS (SELECT transcript_id, strand, CASE WHEN strand = '+' THEN start_ ELSE end_ END AS tss, CASE WHEN strand = '+' THEN end_ ELSE start_ END AS tes FROM gtf WHERE feature_type = 'transcript'), cd AS (SELECT transcript_id, CASE WHEN strand = '+' THEN min(start_) ELSE max(end_) END AS cds FROM gtf WHERE feature_type = 'CDS' GROUP BY transcript_id, strand)"
PROMOTER = ["promoter_hijacking_prom", "promoter_hijacking_utr", "promoter_hijacking", "promoter_hijacking_500", "promoter_hijacking_1000"]


@query(TX_SQL + ", j AS (SELECT id, CASE WHEN strand = '+' THEN tss - breakpoint1 ELSE breakpoint1 - tss END AS up, CASE WHEN strand = '+' THEN breakpoint1 >= tss AND breakpoint1 < cds ELSE breakpoint1 <= tss AND breakpoint1 > cds END AS utr FROM ev LEFT JOIN tx ON transcript_id1 = tx.transcript_id LEFT JOIN cd ON transcript_id1 = cd.transcript_id) SELECT id, " + ", ".join([flag("up > 0 AND up <= 1500", PROMOTER[0]), flag("utr", PROMOTER[1]), flag("coalesce(up > 0 AND up <= 1500, false) OR coalesce(utr, false)", PROMOTER[2]), flag("up > 0 AND up <= 500", PROMOTER[3]), flag("up > 0 AND up <= 1000", PROMOTER[4])]) + " FROM j", "ev", "gtf")
def promoter_hijacking(spark, sf_dir):
    """DOM-14, FLT-03."""
    t = Tables(spark, sf_dir)
    return events.promoter_hijacking(made(t, "ev"), annotation(t)).select("id", *PROMOTER)


NEXT_SQL = ", gene AS (SELECT gene_id, chr, strand, CASE WHEN strand = '+' THEN start_ ELSE end_ END AS tss, CASE WHEN strand = '+' THEN end_ ELSE start_ END AS tes FROM gtf WHERE feature_type = 'gene'), nx AS (SELECT * FROM (SELECT *, lead(gene_id) OVER w AS next_gene_id, lead(tss) OVER w AS next_tss, lead(tes) OVER w AS next_tes FROM gene WINDOW w AS (PARTITION BY chr, strand ORDER BY CASE WHEN strand = '+' THEN tss ELSE -tss END, gene_id)) WHERE next_gene_id IS NOT NULL)"


@query(NEXT_SQL + " SELECT * FROM nx", "gtf")
def next_gene_lookup(spark, sf_dir):
    """DOM-20: a gene's neighbour downstream."""
    return lookups.next_gene(annotation(Tables(spark, sf_dir)))


@query(TX_SQL + NEXT_SQL + ", j AS (SELECT id, breakpoint1 AS b1, breakpoint2 AS b2, a.tes AS a1, b.tss AS a2, chromosome1 = chromosome2 AND gene_strand1 = gene_strand2 AND b.transcript_id = next_gene_id AS sub FROM ev LEFT JOIN tx a ON transcript_id1 = a.transcript_id LEFT JOIN tx b ON transcript_id2 = b.transcript_id LEFT JOIN nx ON nx.gene_id = a.transcript_id AND nx.chr = chromosome1 AND nx.strand = gene_strand1) SELECT id, " + flag("sub AND abs(b2 - b1) <= 10000", "read_through") + ", " + flag("sub AND abs(a2 - a1) <= 20000 AND b1 BETWEEN a1 - 1000 AND a1 + 1000 AND b2 BETWEEN a2 - 1000 AND a2 + 1000", "read_through_loose") + " FROM j", "ev", "gtf")
def read_through(spark, sf_dir):
    """DOM-15, DOM-16, JN-11, JN-12, MTH-03."""
    t = Tables(spark, sf_dir)
    gtf = annotation(t)
    return events.read_through(made(t, "ev"), lookups.next_gene(gtf), gtf).select("id", "read_through", "read_through_loose")


FREE_SQL = ", f AS (SELECT *, gene1 = gene2 AS same, id % 17 = 0 AS rt, id % 19 = 0 AS p5, id % 23 = 0 AS p10 FROM ev)"


def _flagged(t: Tables) -> DataFrame:
    rules = {"read_through": 17, "promoter_hijacking_500": 19, "promoter_hijacking_1000": 23}
    return events.same_gene(made(t, "ev")).withColumns({c: (F.col("id") % n == 0).cast("int") for c, n in rules.items()})


@query(FREE_SQL + " SELECT id, " + ", ".join(flag(f"NOT (same OR rt OR p5 OR p10) AND coverage1 > {v} AND coverage2 > {v}", f"true_{i}") for i, v in enumerate(CFG.coverage_thresholds)) + " FROM f", "ev")
def true_fusions(spark, sf_dir):
    """DOM-17."""
    df = events.true_fusions(_flagged(Tables(spark, sf_dir)))
    return df.select("id", *(F.col(f"`true_fusion_{v}`").alias(f"true_{i}") for i, v in enumerate(CFG.coverage_thresholds)))


COUNT_SQL = {**{f"true_fusion_{v}": f"NOT (same OR rt OR p5 OR p10) AND coverage1 > {v} AND coverage2 > {v}" for v in CFG.coverage_thresholds}, "promoter_hijacking_500": "p5", "promoter_hijacking_1000": "p10", "read_through": "rt", "same_gene_fusion": "same"}


@query(FREE_SQL + " " + " UNION ALL ".join(f"SELECT '{k}' AS type, count(*) AS count FROM f WHERE {v}" for k, v in {**COUNT_SQL, "none": "NOT (" + " OR ".join(f"({v})" for v in COUNT_SQL.values()) + ")"}.items()), "ev")
def event_counts(spark, sf_dir):
    """DOM-18, AGG-04, AGG-05."""
    return events.counts(events.true_fusions(_flagged(Tables(spark, sf_dir))))


CDS_SQL = ", cds AS (SELECT transcript_id, strand, start_, end_, end_ - start_ + 1 AS len, CAST(sum(end_ - start_ + 1) OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '+' THEN start_ ELSE -end_ END, start_, end_ ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM gtf WHERE feature_type = 'CDS')"


@query(CDS_SQL + " SELECT transcript_id, strand, start_, end_, len AS length, cum AS cumulative_length, cum // 3 AS cumulative_length_aa FROM cds", "gtf")
def cds_lookup(spark, sf_dir):
    """DOM-20: coding segments with the running length in reading order."""
    return lookups.cds(annotation(Tables(spark, sf_dir))).withColumnsRenamed({"start": "start_", "end": "end_"})


def _hit_sql(s: int, value: str, name: str) -> str:
    offset = f"cum - len + CASE WHEN gene_strand{s} = '+' THEN breakpoint{s} - start_ ELSE end_ - breakpoint{s} END"
    return f", h{s} AS (SELECT * FROM (SELECT id, {value.format(offset)} AS {name}, row_number() OVER (PARTITION BY id ORDER BY start_, end_) AS n FROM ev JOIN cds ON transcript_id{s} = transcript_id AND start_ <= breakpoint{s} AND end_ >= breakpoint{s}) WHERE n = 1)"


@query(CDS_SQL + ", clean AS (SELECT transcript_id, translate(peptide_sequence, '*\"', 'X.') AS seq, protein_id FROM pep)" + "".join(_hit_sql(s, "CAST(({}) // 3 AS INT)", "aa") for s in (1, 2)) + " SELECT ev.id, coalesce(a.protein_id, '.') AS protein_id, coalesce(b.protein_id, '.') AS protein_id_right, " + ", ".join(f"CASE WHEN h{s}.aa IS NULL THEN '.' ELSE nullif({cut}, '') END AS {part}_peptide{s}" for s, x in ((1, "a"), (2, "b")) for part, cut in (("retained", f"substr(coalesce({x}.seq, '.'), 1, h{s}.aa + 1)"), ("lost", f"substr(coalesce({x}.seq, '.'), h{s}.aa + 2)"))) + " FROM ev LEFT JOIN clean a ON transcript_id1 = a.transcript_id LEFT JOIN clean b ON transcript_id2 = b.transcript_id LEFT JOIN h1 ON ev.id = h1.id LEFT JOIN h2 ON ev.id = h2.id", "ev", "gtf", "pep")
def peptide_stage(spark, sf_dir):
    """DOM-01, DOM-02, DOM-03, PRJ-09, STR-01, STR-02."""
    t = Tables(spark, sf_dir)
    return peptides.build(made(t, "ev"), made(t, "pep"), lookups.cds(annotation(t))).select("id", "protein_id", "protein_id_right", *FRAGMENTS)


@query(CDS_SQL + "".join(_hit_sql(s, "({}) % 3", "frame") for s in (1, 2)) + " SELECT ev.id, h1.frame AS frame1, h2.frame AS frame2, " + flag("h1.frame = h2.frame", "in_frame") + ", " + flag("h1.frame <> h2.frame", "out_of_frame_pair") + ", CASE WHEN h1.frame IS NULL OR h2.frame IS NULL THEN 2 WHEN h1.frame <> h2.frame THEN 1 ELSE 0 END AS out_of_frame1 FROM ev LEFT JOIN h1 ON ev.id = h1.id LEFT JOIN h2 ON ev.id = h2.id", "ev", "gtf")
def frame_flags(spark, sf_dir):
    """DOM-12 on both strands, with overlapping segments."""
    t = Tables(spark, sf_dir)
    df = features.frames(made(t, "ev"), lookups.cds(annotation(t)))
    return df.select("id", "frame1", "frame2", F.col("in_frame").cast("int").alias("in_frame"), F.col("out_of_frame_pair").cast("int").alias("out_of_frame_pair"), "out_of_frame1")


COMPARED_SQL = ", long AS (" + " UNION ALL ".join(f"SELECT CAST(a.id AS VARCHAR) AS id, '{c}' AS col, a.{c} AS a, b.{c} AS b FROM dom_a a JOIN dom_b b USING (id)" for c in DOMAIN_COLUMNS) + "), s AS (SELECT id, col, " + ", ".join(f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[|,]'), lambda v: trim(v)), lambda v: regexp_matches(v, '^IPR[0-9]{{6}}$')))) AS {x}" for x in "ab") + """ FROM long),
m AS (SELECT *, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS lost, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS extra, len(list_intersect(a, b)) AS i FROM s),
r AS (SELECT *, len(a) + len(b) - i AS u, CASE WHEN len(b) > 0 THEN CAST(i AS DOUBLE) / len(b) ELSE 0.0 END AS p, CASE WHEN len(a) > 0 THEN CAST(i AS DOUBLE) / len(a) ELSE 0.0 END AS c FROM m),
q AS (SELECT id, col, """ + ", ".join(f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, '|') ELSE '.' END AS {n}" for x, n in (("a", "iprs_interpro"), ("b", "iprs_faiss"), ("lost", "missing_in_faiss"), ("extra", "extra_in_faiss"))) + ", " + ", ".join(f"CAST({x} AS INT) AS {n}" for x, n in (("len(a)", "n_ipro"), ("len(b)", "n_faiss"), ("i", "n_intersection"), ("u", "n_union"), ("len(lost)", "n_missing"), ("len(extra)", "n_extra"), ("len(lost) = 0", "all_interpro_in_faiss"))) + ", round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN i > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END, 6) AS f1, round(CASE WHEN u > 0 THEN CAST(i AS DOUBLE) / u ELSE 0.0 END, 6) AS jaccard FROM r)"


@query(COMPARED_SQL + " SELECT * FROM q", "dom_a", "dom_b")
def comparison_rows(spark, sf_dir):
    """DOM-22, JN-13, MTH-04, STR-09."""
    t = Tables(spark, sf_dir)
    return comparison.rows(made(t, "dom_a"), made(t, "dom_b"))


MEANS = ["precision", "recall", "f1", "jaccard"]


@query(COMPARED_SQL + " SELECT coalesce(col, 'ALL_COLUMNS') AS col, count(*) AS n_rows, count(*) FILTER (WHERE n_missing = 0) AS n_full_subset, " + half_even("avg(all_interpro_in_faiss) * 100", 2) + " AS pct_full_subset, count(*) FILTER (WHERE n_missing > 0) AS n_partial_subset, round(avg(n_missing), 6) AS mean_missing, round(avg(n_extra), 6) AS mean_extra, " + ", ".join(f"round(avg({c}), 5) AS {c}_mean" for c in MEANS) + " FROM q GROUP BY ROLLUP (col)", "dom_a", "dom_b")
def comparison_stats(spark, sf_dir):
    """DOM-22, AGG-02, AGG-03."""
    t = Tables(spark, sf_dir)
    g = comparison.stats(comparison.rows(made(t, "dom_a"), made(t, "dom_b")))
    return g.withColumns({c: F.round(c, 6) for c in ("mean_missing", "mean_extra")} | {f"{c}_mean": F.round(f"{c}_mean", 5) for c in MEANS})


@query(", run AS (SELECT p.page_id, side, half, x, x - row_number() OVER (PARTITION BY p.page_id, side, half ORDER BY x) AS island, CASE WHEN coalesce(max_height, 0) > 0 THEN height * (max_height / 84.0::DOUBLE) ELSE 0.0::DOUBLE END AS reads FROM pixels p LEFT JOIN heights h ON p.page_id = h.page_id WHERE bottom) SELECT page_id, side, half, min(x) AS start_, " + half_even("avg(reads)", 2) + " AS mean, " + half_even("median(reads)", 2) + " AS median FROM run GROUP BY page_id, side, half, island", "pixels", "heights")
def exon_segments(spark, sf_dir):
    """DOM-24, AGG-08, WIN-07."""
    t = Tables(spark, sf_dir)
    return expression.exons(made(t, "pixels"), made(t, "heights")).withColumnRenamed("start", "start_")


def _coverage_sql() -> str:
    half = f", halves AS (SELECT page_id, side, half, {half_even('avg(mean)', 3)} AS mean, {half_even('avg(median)', 3)} AS median FROM exon_rows GROUP BY ALL)"
    out = []
    for s in (1, 2):
        for m in ("mean", "median"):
            cell = lambda h: f"coalesce((SELECT max({m}) FROM halves h WHERE h.page_id = p.page_id AND side = {s} AND half = '{h}'), 0.0)"  # noqa: B023, E731
            first, second = ("LR", "RL")[s - 1]
            for name, (plus, minus) in (("retained", (first, second)), ("lost", (second, first))):
                out.append(f"CASE WHEN transcript_id{s} IS NOT NULL AND strand{s} = '+' THEN {cell(plus)} WHEN transcript_id{s} IS NOT NULL AND strand{s} = '-' THEN {cell(minus)} ELSE 0.0 END AS {m}_{name}{s}")
    ratio = ", ".join(f"CASE WHEN mean_retained{s} <> 0 AND mean_lost{s} <> 0 THEN {half_even(f'mean_retained{s} / mean_lost{s}', 3)} ELSE 0.0 END AS coverage{s}" for s in (1, 2))
    return f"{half}, w AS (SELECT *, {', '.join(out)} FROM sheets p) SELECT *, {ratio} FROM w"


@query(_coverage_sql(), "exon_rows", "sheets")
def page_coverage(spark, sf_dir):
    """DOM-23, AGG-09."""
    t = Tables(spark, sf_dir)
    return expression.coverage(made(t, "exon_rows"), made(t, "sheets"))


@query(" SELECT *, end_ - start_ + 1 AS feat_len FROM hits WHERE end_ - start_ + 1 BETWEEN 30 AND 600 AND ipr_id NOT IN ('', '.', '-')", "hits")
def merged_hits(spark, sf_dir):
    """DOM-28: two chunks of annotator output, merged and filtered."""
    h = made(Tables(spark, sf_dir), "hits")
    even = F.col("start") % 2 == 0
    return retrieval.merge_hits([h.filter(even), h.filter(~even)]).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(", g AS (SELECT *, split_part(protein_id, '.', 1) AS p FROM hits WHERE end_ >= start_ AND end_ - start_ + 1 BETWEEN 30 AND 600), j AS (SELECT g.*, sequence, CAST(greatest(1, start_ - 32) AS BIGINT) AS lo, least(length(sequence), end_ + 32) AS hi FROM g JOIN proteins ON p = proteins.protein_id) SELECT p || ':' || start_ || '-' || end_ || ':' || coalesce(signature_accession, 'NA') AS window_id, p AS protein_id, start_ AS aa_start, end_ AS aa_end, lo AS window_start, hi AS window_end, length(CASE WHEN hi >= lo THEN substr(sequence, lo, hi - lo + 1) ELSE '' END) AS window_len, signature_accession, ipr_id, ipr_desc AS ipr_name, analysis, CASE WHEN hi >= lo THEN substr(sequence, lo, hi - lo + 1) ELSE '' END AS sequence FROM j", "hits", "proteins")
def domain_windows(spark, sf_dir):
    """DOM-21, FLT-07, STR-13."""
    t = Tables(spark, sf_dir)
    return retrieval.domain_windows(made(t, "hits"), made(t, "proteins"))


def _cells_sql(values: str) -> str:
    cell = lambda c, v: f"coalesce(max(CASE WHEN col = '{c}' THEN {v} END), '.') AS {c.replace('peptide', 'domains' if v == 'domains' else 'domain_names')}"
    return f"{values} SELECT frag.id, {', '.join(cell(c, v) for c in FRAGMENTS for v in ('domains', 'names'))} FROM frag LEFT JOIN cells ON frag.id = cells.id GROUP BY frag.id"


FRAGMENT_ROWS = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {c} AS sequence FROM frag" for c in FRAGMENTS)
CELLS = [c.replace("peptide", n) for n in ("domains", "domain_names") for c in FRAGMENTS]


@query(_cells_sql(f", q AS ({FRAGMENT_ROWS}), h AS (SELECT id, col, n, 'IPR' || (id * n % 5) AS accession, CASE WHEN n % 3 > 0 THEN 'n' || n END AS name FROM q, (SELECT unnest(range(1, 7)) AS n) WHERE sequence <> '.' AND (id + n) % 4 > 0), f AS (SELECT id, col, accession, min(n) AS n FROM h GROUP BY ALL), cells AS (SELECT f.id, f.col, string_agg(f.accession, ' | ' ORDER BY f.n) AS domains, string_agg(coalesce(h.name, 'NA'), ' | ' ORDER BY f.n) AS names FROM f JOIN h USING (id, col, n) GROUP BY ALL)"), "frag")
def annotated_domains(spark, sf_dir):
    """DOM-05, AGG-06, STR-16: six hits of a made-up annotator for each fragment."""

    def annotator(queries: DataFrame) -> DataFrame:
        number, n = F.substring_index("query", "|", 1).cast("bigint"), F.col("n")
        rows = queries.select("query", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).filter((number + n) % 4 > 0)
        return rows.select("query", F.concat(F.lit("IPR"), number * n % 5).alias("accession"), F.when(n % 3 > 0, F.concat(F.lit("n"), n)).alias("name"), "n").orderBy("query", "n").drop("n")

    return retrieval.by_annotator(made(Tables(spark, sf_dir), "frag"), annotator).select("id", *CELLS)


def letter_counts(sequences: list[str]):
    """An embedder that SQL has too: how often each of three letters occurs."""
    import numpy as np

    return np.array([[s.count(x) for x in "ACD"] for s in sequences], np.float32)


@query(_cells_sql(f", q AS ({FRAGMENT_ROWS}), " + "v AS (SELECT id, col, " + ", ".join(f"CAST(length(sequence) - length(replace(sequence, '{x}', '')) AS DOUBLE) AS {x.lower()}" for x in "ACD") + " FROM q), u AS (SELECT *, greatest(sqrt(a * a + c * c + d * d), 1e-12) AS size FROM v), s AS (SELECT id, col, pos, ipr_id, ipr_name, round(a / size * v1 + c / size * v2 + d / size * v3, 6) AS score FROM u, parts), r AS (SELECT *, row_number() OVER (PARTITION BY id, col ORDER BY score DESC, pos) AS rank FROM s), b AS (SELECT id, col, ipr_id, arg_min(ipr_name, rank) AS name, max(score) AS best, min(rank) AS f FROM r WHERE rank <= 256 GROUP BY id, col, ipr_id), k AS (SELECT *, row_number() OVER (PARTITION BY id, col ORDER BY f) AS place FROM b), cells AS (SELECT id, col, string_agg(ipr_id, '|' ORDER BY best DESC, place) AS domains, string_agg(CASE WHEN trim(name) <> '' THEN name ELSE 'NA' END, '|' ORDER BY best DESC, place) AS names FROM k WHERE place <= 8 GROUP BY ALL)"), "frag", "parts")
def searched_domains(spark, sf_dir):
    """DOM-04, ML-01 to ML-03, ARR-04, WIN-10: fragments embedded, searched in an index, the best distinct domains kept."""
    t = Tables(spark, sf_dir)
    index = made(t, "parts").select("pos", "ipr_id", "ipr_name", F.array("v1", "v2", "v3").alias("vec"))
    return retrieval.by_search(made(t, "frag"), index, letter_counts).select("id", *CELLS)


KEYS_SQL = ", ".join(assemble.KEYS)


@query(" SELECT id, gene1, gene2, transcript_id1, transcript_id2, chromosome1, chromosome2, breakpoint1, breakpoint2, 'd' || (id % 3) AS domain, CASE WHEN id % 2 = 0 AND fusion_strand1 IS NOT NULL THEN coverage1 END AS height, id % 4 AS feature, CASE WHEN id % 5 > 0 THEN id % 6 END AS noted, id / 10.0 AS driver_score FROM ev", "ev")
def complete_table(spark, sf_dir):
    """DOM-26, JN-04, JN-06: stage tables joined, a column belongs to the first that has it."""
    ev = made(Tables(spark, sf_dir), "ev")
    base = ev.select("id", *assemble.KEYS)
    id_ = F.col("id")
    domains = ev.select("id", F.concat(F.lit("d"), id_ % 3).alias("domain"), F.lit("other").alias("gene1"))
    feats = ev.select("id", (id_ % 4).alias("feature"), F.lit("late").alias("domain"))
    noted = ev.filter("id % 5 > 0").select("id", (id_ % 6).alias("noted"), F.lit(-1).alias("feature"))
    heights = ev.filter("id % 2 = 0 AND fusion_strand1 IS NOT NULL").select(*assemble.KEYS, F.col("coverage1").alias("height"))
    return assemble.complete(base, domains, feats, noted, ev.select("id", (id_ / 10.0).cast("double").alias("driver_score")), heights)


@query(" SELECT CAST(id AS VARCHAR) AS id, NULL::VARCHAR AS gene1, NULL::VARCHAR AS gene2, retained_domains1, lost_domains1, retained_domains2, lost_domains2, NULL::VARCHAR AS out_of_frame1, NULL::VARCHAR AS out_of_frame2, 'event' AS source FROM dom_a", "dom_a")
def aligned_core(spark, sf_dir):
    """PRJ-08, ML-14, ML-15: older names renamed, missing columns null."""
    old = {new: former for former, new in scoring.OLD_NAMES.items()}
    return scoring.aligned(made(Tables(spark, sf_dir), "dom_a").withColumnsRenamed(old), "event")


def written(lines: DataFrame, name: str) -> str:
    """Lines as a text folder in the shared folder."""
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query(" SELECT transcript_id::VARCHAR AS transcript_id, gene_id::VARCHAR AS gene_id, feature_type, strand, chr, start_, end_, CASE WHEN tags = '' THEN '' ELSE tags END AS tags FROM gtf", "gtf")
def gtf_reader(spark, sf_dir):
    """SRC-14 to SRC-16, STR-06, STR-08: features written as GTF lines, with comments, and read."""
    g = made(Tables(spark, sf_dir), "gtf")
    tags = F.array_join(F.transform(F.filter(F.split("tags", ","), lambda x: x != ""), lambda x: F.concat(F.lit(' tag "'), x, F.lit('";'))), "")
    ids = F.concat(F.lit('gene_id "'), "gene_id", F.lit('.4";'), F.coalesce(F.concat(F.lit(' transcript_id "'), F.col("transcript_id").cast("string"), F.lit('.2";')), F.lit("")), tags)
    lines = g.select(F.concat_ws("\t", "chr", F.lit("made"), "feature_type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), ids).alias("value"))
    path = written(lines.union(spark.createDataFrame([("#!comment",), ("1\tshort",)], "value string")), "gtf")
    return tables.read_gtf(spark, path).withColumn("tags", F.array_join("tags", ",")).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(" SELECT 'P' || (transcript_id) AS protein_id, 'T' || (transcript_id) AS transcript_id, peptide_sequence FROM pep", "pep")
def fasta_reader(spark, sf_dir):
    """SRC-11, SRC-12, DOM-19: records of several lines written and read as the peptide lookup."""
    p = made(Tables(spark, sf_dir), "pep")
    record = F.concat(F.lit(">"), "protein_id", F.lit(".1 pep transcript:T"), F.col("transcript_id").cast("string"), F.lit(".3 x\n"), F.substring("peptide_sequence", 1, 4), F.lit("\n"), F.expr("substring(peptide_sequence, 5)"))
    return lookups.fasta_lookups(tables.read_fasta(spark, written(p.select(record.alias("value")), "fasta")))["peptide_lookup"].select("protein_id", "transcript_id", "peptide_sequence")


@query(" SELECT id, gene1, gene2, transcript_id1::VARCHAR AS transcript_id1, transcript_id2::VARCHAR AS transcript_id2, chromosome1, chromosome2, breakpoint1, breakpoint2, fusion_strand1 FROM ev", "ev")
def event_reader(spark, sf_dir):
    """SRC-01 to SRC-04, SRC-06: events written as a delimited table in other case, null tokens included, and read."""
    ev = made(Tables(spark, sf_dir), "ev")
    names = ["id", *assemble.KEYS, "fusion_strand1"]
    titles = {"id": "id", "fusion_strand1": "FusionStrand1", "gene1": "Gene1"}
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    ev.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(titles.get(c, c)) for c in names)).write.option("header", True).option("sep", ",").csv(path)
    return tables.load_events(spark, path).select(*names)


@query(" SELECT 'q' || c_custkey AS query, 'IPR' || (c_custkey % 9) AS accession, c_mktsegment AS name FROM customer WHERE c_custkey % 4 > 0", "frag")
def annotator_reader(spark, sf_dir):
    """SRC-16: columns 1, 12 and 13 of an annotator's lines, those without accession left out."""
    c = Tables(spark, sf_dir).customer
    cells = [F.concat(F.lit("q"), "c_custkey"), *(F.lit("x"),) * 10, F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" IPR"), F.col("c_custkey") % 9)).otherwise(""), "c_mktsegment", F.lit("-"), F.lit("-")]
    return tables.read_annotator(spark, written(c.select(F.concat_ws("\t", *cells).alias("value")), "annotator"))


@query(" SELECT upper(trim(c_mktsegment)) AS symbol FROM customer GROUP BY 1", "frag")
def symbol_reader(spark, sf_dir):
    """SRC-18: a list of symbols, in upper case, once each."""
    return tables.read_symbols(spark, written(Tables(spark, sf_dir).customer.select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("value")), "symbols"))


@query(" SELECT doc AS page_id, 'AB' || doc % 3 AS gene1, 'CD1' AS gene2, 'ENST' || doc AS transcript_id1, CASE WHEN doc % 2 = 0 THEN 'ENST9' END AS transcript_id2, 'X' AS chromosome1, (doc % 20 + 1)::VARCHAR AS chromosome2, doc AS breakpoint1, doc * 7 AS breakpoint2, (doc % 300)::INT AS max_height FROM (SELECT c_custkey AS doc FROM customer)", "frag")
def page_metadata(spark, sf_dir):
    """SRC-20, STR-08: the fields of a plot page from its text."""
    c = Tables(spark, sf_dir).customer
    doc = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("ab"), F.col("c_custkey") % 3, F.lit(" and CD1\nENST"), doc, F.when(F.col("c_custkey") % 2 == 0, " ENST9").otherwise(""), F.lit("\nchrX:"), doc, F.lit("\n"), F.col("c_custkey") % 20 + 1, F.lit(":"), F.col("c_custkey") * 7, F.lit("\nheight "), F.col("c_custkey") % 300)
    symbols = spark.createDataFrame([("AB0",), ("AB1",), ("AB2",), ("CD1",)], "symbol string")
    return tables.page_fields(c.select(F.col("c_custkey").alias("page_id"), text.alias("text")), symbols).withColumn("gene1", F.upper("gene1"))


@query(" SELECT id AS page_id, a.strand AS strand1, b.strand AS strand2 FROM ev LEFT JOIN (SELECT DISTINCT transcript_id, strand FROM gtf) a ON transcript_id1 = a.transcript_id LEFT JOIN (SELECT DISTINCT transcript_id, strand FROM gtf) b ON transcript_id2 = b.transcript_id", "ev", "gtf")
def page_strands(spark, sf_dir):
    """JN-16: the strand of both transcripts of a page."""
    t = Tables(spark, sf_dir)
    pages = made(t, "ev").select(F.col("id").alias("page_id"), "transcript_id1", "transcript_id2")
    return expression.with_strands(pages, annotation(t)).select("page_id", "strand1", "strand2")


@query(" SELECT c_custkey, upper(replace(trim(' ' || c_name || ' x '), ' ', '')) AS symbol FROM customer", "frag")
def clean_symbols(spark, sf_dir):
    """STR-05."""
    return Tables(spark, sf_dir).customer.select("c_custkey", tx.symbol(F.concat(F.lit(" "), "c_name", F.lit(" x "))).alias("symbol"))


_CELLS = [("r1", "retained_domains1"), ("l1", "lost_domains1"), ("r2", "retained_domains2"), ("l2", "lost_domains2")]
_PARTS = "list_filter(list_transform(string_split({0}, '|'), lambda x: trim(x)), lambda x: x <> '')"
_CLEAN = "CASE WHEN coalesce(trim({0}), '') NOT IN ('', '.') THEN " + _PARTS + " ELSE [] END"
_FRAME = "coalesce(TRY_CAST(out_of_frame{0} AS DOUBLE), 2.0)"
#: Chained steps: tokens, weights, unit vectors, the 20 nearest of each by cosine, the graph, its diffusion to convergence, and the range from 0 to 1.
DRIVER_SQL = f""", t AS (SELECT *, CASE WHEN source = 'positive' THEN 0 ELSE 1 END AS late, row_number() OVER (ORDER BY source, CAST(k AS VARCHAR), gene1, gene2) AS row_ FROM fused),
tok AS (SELECT row_, token FROM ({' UNION ALL '.join(f"SELECT row_, '{k}:' || replace(array_to_string({_CLEAN.format(c)}, ' | '), ' ', '_') AS token, len({_CLEAN.format(c)}) AS n FROM t" for k, c in _CELLS)}) WHERE n > 0),
tf AS (SELECT row_, token, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT row_, token, tf * (ln((1 + (SELECT count(DISTINCT row_) FROM tok)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (token)), text AS (SELECT row_, token, w / sqrt(sum(w * w) OVER (PARTITION BY row_)) AS w FROM w),
num AS (SELECT row_, x.token AS token, x.w AS w FROM (SELECT row_, unnest([{{'token': '#of1', 'w': {_FRAME.format(1)}}}, {{'token': '#of2', 'w': {_FRAME.format(2)}}}, {', '.join(f"{{'token': '#{k}', 'w': CAST(len({_CLEAN.format(c)}) AS DOUBLE)}}" for k, c in _CELLS)}, {{'token': '#nc1', 'w': CASE WHEN {_FRAME.format(1)} = 2 THEN 1.0 ELSE 0.0 END}}, {{'token': '#nc2', 'w': CASE WHEN {_FRAME.format(2)} = 2 THEN 1.0 ELSE 0.0 END}}]) AS x FROM t) WHERE x.w <> 0),
f AS (SELECT row_, token, w / sqrt(sum(w * w) OVER (PARTITION BY row_)) AS w FROM (SELECT * FROM text UNION ALL SELECT * FROM num)),
cos AS (SELECT a.row_ AS src, b.row_ AS dst, round(sum(a.w * b.w), 6) AS w FROM f a JOIN f b USING (token) GROUP BY 1, 2), near AS (SELECT src, dst, w FROM cos WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 20),
half AS (SELECT src, dst, w / 2 AS w FROM near), adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM half UNION ALL SELECT dst, src, w FROM half) WHERE src <> dst GROUP BY 1, 2 HAVING sum(w) > 0), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM adj),
seeds AS (SELECT row_ AS node, CAST(CASE WHEN source = 'positive' THEN 1 ELSE 0 END AS DOUBLE) AS y FROM t), {until_converged('p', 'seeds', '0.9', '1e-6')},
last AS (SELECT node, s FROM it WHERE i = (SELECT max(i) FROM it)), final AS (SELECT node, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS score FROM last)
SELECT k AS id, gene1, gene2, round(CAST(score AS DOUBLE), 4) AS driver_score FROM final JOIN t ON node = row_ WHERE source = 'event'"""


@query(DRIVER_SQL, "fused")
def driver_scores(spark, sf_dir):
    """DOM-27, ML-05 to ML-11: scores of events from known drivers, over the exact graph of nearest neighbours."""
    df = made(Tables(spark, sf_dir), "fused").withColumn("id", F.col("k").cast("string"))
    out = scoring.score(df.filter("source = 'event'"), df.filter("source = 'positive'"), CFG)
    return out.select("id", "gene1", "gene2", F.round(F.col("driver_score").cast("double"), 4).alias("driver_score"))


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(" SELECT row_number() OVER (PARTITION BY kind ORDER BY vec_id) - 1 AS pos, kind, embedding[1] AS first, embedding[64] AS last, len(embedding)::INT AS width FROM embeddings, (SELECT unnest(['npy', 'ip', 'l2']) AS kind)", "frag")
def matrix_files(spark, sf_dir):
    """SRC-22, SNK-07: vectors written as a matrix and as flat indexes of both metrics, in parts, and read by ranges of rows."""
    e = Tables(spark, sf_dir).embeddings.select((F.col("vec_id") * 3).alias("pos"), F.col("embedding").alias("vec"))
    found = []
    for kind in ("npy", "ip", "l2"):
        path = matrix.save_vectors(e, _folder(spark, f"vectors-{kind}"), kind, rows_per_part=200)
        found.append(matrix.read_vectors(spark, path, 150).select("pos", F.lit(kind).alias("kind"), F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(63)).alias("last"), F.size("vec").alias("width")))
    return found[0].union(found[1]).union(found[2])


_FA_SQL = """ SELECT 'peptide_lookup' AS output, 'T' || transcript_id AS transcript_id, replace(peptide_sequence, ' ', '') AS peptide_sequence, protein_id, NULL AS value FROM pep WHERE transcript_id % 5 > 0
UNION ALL SELECT 'protein_lookup', NULL, peptide_sequence, protein_id, NULL FROM pep UNION ALL SELECT 'clean_fasta', NULL, NULL, NULL, '>' || protein_id || chr(10) || peptide_sequence FROM pep"""


@query(_FA_SQL, "pep")
def fasta_outputs(spark, sf_dir):
    """SNK-04, SRC-11 to SRC-13: headers that hold marks, gzip; three outputs written in one pass and read again."""
    p = made(Tables(spark, sf_dir), "pep")
    transcript = F.when(F.col("transcript_id") % 5 > 0, F.concat(F.lit(" transcript:T"), F.col("transcript_id").cast("string"), F.lit(".3"))).otherwise("")
    record = F.concat(F.lit(">"), "protein_id", F.lit(".1 pep"), transcript, F.lit(" binding A->B > C\r\n"), F.substring("peptide_sequence", 1, 4), F.lit("\n"), F.expr("substring(peptide_sequence, 5)"))
    source, folder = _folder(spark, "fasta"), _folder(spark, "outputs")
    p.select(record.alias("value")).write.option("compression", "gzip").text(source)
    writers.save_outputs(lookups.fasta_outputs(tables.read_fasta(spark, source)), "output", folder, "made_")
    cells = "transcript_id string, peptide_sequence string, protein_id string, value string"
    rows = [spark.read.schema(cells).parquet(f"{folder}/made_{name}").withColumn("output", F.lit(name)) for name in lookups.FASTA_OUTPUTS]
    return rows[0].union(rows[1]).union(rows[2]).select("output", "transcript_id", "peptide_sequence", "protein_id", "value")


@query(" SELECT CAST(least((row_number() OVER (ORDER BY protein_id) - 1) // greatest(1, CAST(ceil((SELECT count(*) FROM proteins) / 8.0) AS BIGINT)), 7) AS INT) AS chunk, '>' || protein_id AS header, sequence FROM proteins", "proteins")
def chunk_files(spark, sf_dir):
    """SNK-05: records in chunk files, written in one pass and read again."""
    p = made(Tables(spark, sf_dir), "proteins")
    path = _folder(spark, "chunks")
    writers.save_chunks(p.select("protein_id", F.concat(F.lit(">"), "protein_id", F.lit("\t"), "sequence").alias("value")), ["protein_id"], 8, path)
    cells = F.split("value", "\t")
    return spark.read.text(path).select(F.col("chunk").cast("int").alias("chunk"), cells[0].alias("header"), cells[1].alias("sequence"))


def first_letters(rows):
    """An annotator for queries: sequences of over 4 letters are hit, by their first letter and their length."""
    long = rows[rows["sequence"].str.len() > 4]
    return long.assign(accession="IPR" + long["sequence"].str[0], name="n" + long["sequence"].str.len().astype(str))[["query", "accession", "name"]]


_LONG_SQL = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {c} AS s FROM frag" for c in FRAGMENTS)
_CELL_SQL = ", ".join(f"coalesce(max({cell}) FILTER (WHERE col = '{c}'), '.') AS {c.replace('peptide', kind)}" for kind, cell in (("domains", "'IPR' || substr(s, 1, 1)"), ("domain_names", "'n' || length(s)")) for c in FRAGMENTS)


@query(f", l AS (SELECT * FROM ({_LONG_SQL}) WHERE length(s) > 4) SELECT frag.id, {_CELL_SQL} FROM frag LEFT JOIN l USING (id) GROUP BY 1", "frag")
def annotator_batches(spark, sf_dir):
    """DOM-05, SRC-23: an annotator over batches of 100 sequences with a ledger."""
    events_ = made(Tables(spark, sf_dir), "frag")
    return retrieval.by_annotator(events_, retrieval.batch_annotator(first_letters, _folder(spark, "batches"), 100)).select("id", *CELLS)


#: A pixel of a generated page by page k, row y and column x: a white gap, markers in the first channel, exons, and light grey.
_PIXEL = "CASE WHEN x BETWEEN 820 + k % 7 * 10 AND 909 + k % 7 * 10 + k % 40 THEN 16777215 WHEN k % 5 > 0 AND x IN (400 + k % 50, 401 + k % 50, 1250 + k % 90, 1251 + k % 90) THEN 16711680 WHEN ((x - x % 37) + 37 * k) % 111 = 0 AND y >= 334 - (x * 7 + k) % 84 THEN 11250603 ELSE 15132390 END"
_RASTER_SQL = f""", px AS (SELECT k, y, x, CAST({_PIXEL} AS BIGINT) AS c FROM (SELECT s_suppkey AS k FROM supplier), (SELECT unnest(range(250, 334)) AS y), (SELECT unnest(range(220, 1600)) AS x)),
ch AS (SELECT k, y, x - 220 AS x, c // 65536 AS b, c // 256 % 256 AS g, c % 256 AS r FROM px), gr AS (SELECT k, y, x, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS gray, b - (r + g) // 2 AS blue FROM ch),
prof AS (SELECT k, x, avg(gray) AS mean, max(blue) AS blue, count(*) FILTER (WHERE abs(gray - 171) <= 40) AS height, bool_or(y = 333 AND abs(gray - 171) <= 40) AS bottom FROM gr GROUP BY 1, 2),
runs AS (SELECT k, min(x) AS low, count(*) AS len FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM prof WHERE mean > 240) GROUP BY k, i), gap AS (SELECT k, (2 * low + len) // 2 AS centre FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY len DESC, low) = 1),
side AS (SELECT k, 1 AS side, x, blue, height, bottom, centre - 33 AS width FROM prof JOIN gap USING (k) WHERE x < centre - 33 UNION ALL SELECT k, 2, x - centre - 33, blue, height, bottom, 1380 - centre - 33 FROM prof JOIN gap USING (k) WHERE x >= centre + 33),
mark AS (SELECT k, side, coalesce(CAST(floor(avg(x) FILTER (WHERE blue > 100)) AS BIGINT), any_value(width) // 2) AS cut FROM side GROUP BY 1, 2),
pixels AS (SELECT CAST(k AS VARCHAR) AS page_id, side, CASE WHEN x < cut THEN 'L' ELSE 'R' END AS half, CASE WHEN x < cut THEN x ELSE x - cut - 2 END AS x, bottom, height FROM side JOIN mark USING (k, side) WHERE x < cut OR x >= cut + 2),
heights AS (SELECT CAST(s_suppkey AS VARCHAR) AS page_id, s_suppkey % 5 * 84 AS max_height FROM supplier),
run AS (SELECT p.page_id, side, half, x, x - row_number() OVER (PARTITION BY p.page_id, side, half ORDER BY x) AS island, CASE WHEN coalesce(max_height, 0) > 0 THEN height * (max_height / 84.0::DOUBLE) ELSE 0.0::DOUBLE END AS reads FROM pixels p LEFT JOIN heights h ON p.page_id = h.page_id WHERE bottom)
SELECT page_id, CAST(side AS INT) AS side, half, CAST(min(x) AS INT) AS start_, {half_even("avg(reads)", 2)} AS mean, {half_even("median(reads)", 2)} AS median FROM run GROUP BY page_id, side, half, island"""


def drawn(content: bytes):
    """A renderer for queries: the page of the number in `content`, with the pixels of _PIXEL in rows 240 to 340."""
    import numpy as np

    k, x, y = int(bytes(content)), np.arange(1_700), np.arange(240, 341)[:, None]
    low = 820 + k % 7 * 10
    gap, mark = (x >= low) & (x <= low + 89 + k % 40), (k % 5 > 0) & np.isin(x, [400 + k % 50, 401 + k % 50, 1250 + k % 90, 1251 + k % 90])
    signal = (((x - x % 37) + 37 * k) % 111 == 0) & (y >= 334 - (x * 7 + k) % 84)
    page = np.full((341, 1_700, 3), 255, np.uint8)
    page[240:] = np.where(signal, 171, 230)[..., None]
    page[240:, mark] = (255, 0, 0)
    page[240:, gap] = 255
    return [page]


@query(_RASTER_SQL, "frag")
def page_raster(spark, sf_dir):
    """DOM-25, DOM-24, SRC-20: pages rendered to packed image rows, through crop, gap, halves and marker to exons."""
    s = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("k")).repartition(64, "k")  # a page is some hundred rows of 1,700 pixels
    documents = s.select(F.col("k").cast("string").alias("path"), F.col("k").cast("string").cast("binary").alias("content"))
    pages = raster.rasters(documents, drawn).withColumn("page_id", F.substring_index("page_id", "#", 1))
    heights = s.select(F.col("k").cast("string").alias("page_id"), (F.col("k") % 5 * 84).cast("int").alias("max_height"))
    return expression.exons(raster.pixel_columns(pages), heights).withColumnRenamed("start", "start_")


def _event_stream(spark, sf_dir: str, files: int = 6):
    """Events as a stream of several files in order of time, one file a batch."""
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', CAST(ts AS TIMESTAMP_NTZ)))")  # whatever the session's time zone
    ev = Tables(spark, sf_dir).events.select("event_id", instant.alias("ts"), "user_id", "event_type", "value")
    folder = _folder(spark, "events")
    n = Tables(spark, sf_dir).events.count()
    files = max(files, n // 1_000_000)
    parts = numbered(ev, ["ts", "event_id"], "n").withColumn("part", F.floor((F.col("n") - 1) * files / n))
    dealt = _folder(spark, "dealt")
    parts.drop("n").write.partitionBy("part").parquet(dealt)  # one pass deals all rows; each file below reads its own alone
    for i in range(files):  # written one after the other, so that the stream takes them in that order
        rows = spark.read.schema(ev.schema).parquet(f"{dealt}/part={i}") if n else ev
        rows.coalesce(1).write.parquet(f"{folder}/p{i}")
    return intake.table_stream(spark, f"{folder}/*", ev.schema, files=1)


_MARK = "(SELECT CAST(epoch_us(max(ts)) // 1000 - 600000 AS BIGINT) AS mark FROM events)"


@query(f" SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS n FROM events, {_MARK} GROUP BY event_type, date_trunc('hour', ts), mark HAVING epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark", "frag")
def stream_windows(spark, sf_dir):
    """ST-03: counts by hour that the watermark has closed, appended once each."""
    counted = intake.windowed_counts(_event_stream(spark, sf_dir), "ts", "event_type")
    flat = counted.select("event_type", F.unix_millis(F.col("window.start")).alias("start_ms"), "n")
    folder = _folder(spark, "windows")
    intake.append_once(flat, folder, _folder(spark, "checkpoint")).awaitTermination()
    return intake.appended(spark, folder, flat.schema)


@query(f", t AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, CASE WHEN (epoch_us(ts) // 1000) - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) < 1800000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT user_id, min(ms) AS start_ms, max(ms) + 1800000 AS end_ms, count(*) AS n FROM g, {_MARK} GROUP BY user_id, s, mark HAVING max(ms) + 1800000 <= mark", "frag")
def stream_sessions(spark, sf_dir):
    """ST-03: sessions as state of each user, emitted once when the watermark has closed them."""
    found = intake.state_sessions(_event_stream(spark, sf_dir), "ts", "user_id")
    flat = found.select(F.col("key").alias("user_id"), F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")
    folder = _folder(spark, "sessions")
    intake.append_once(flat, folder, _folder(spark, "checkpoint")).awaitTermination()
    return intake.appended(spark, folder, flat.schema)


@query(" SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1", "frag")
def stream_latest(spark, sf_dir):
    """ST-01: the latest event of each user, merged batch by batch."""
    stream = _event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    folder = _folder(spark, "latest")
    intake.keep_latest(stream, folder, ["user_id"], ["ts", "event_id"], _folder(spark, "checkpoint")).awaitTermination()
    return intake.latest(spark, folder, stream.schema).select("user_id", "event_id", "event_type")


@query(" SELECT 'list' AS layout, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, NULL AS window_id, CASE s_suppkey % 4 WHEN 0 THEN 'IPR' || s_suppkey WHEN 1 THEN 'ipr' || s_suppkey WHEN 2 THEN 'PF' || s_suppkey ELSE '.' END AS ipr_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS ipr_name FROM supplier UNION ALL SELECT 'windows', row_number() OVER (ORDER BY s_suppkey) - 1, 'w' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE 'IPR' || s_nationkey END, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END FROM supplier", "frag")
def index_metadata(spark, sf_dir):
    """SRC-17, JSN-01: metadata of an index in both layouts, with their other key names, written as JSON and read."""
    s = Tables(spark, sf_dir).supplier
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    kind, ipr = F.col("s_suppkey") % 4, lambda prefix: F.concat(F.lit(prefix), key)
    item = F.struct(F.when(kind == 0, ipr("IPR")).alias("IPR"), F.when(kind == 1, ipr("ipr")).alias("ipr"), F.when(kind == 2, ipr("PF")).alias("signature_accession"), F.when(F.col("s_suppkey") % 3 == 1, name).alias("name"), F.when(F.col("s_suppkey") % 3 == 2, name).alias("ipr_desc"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", c.alias("x")))), lambda e: e["x"])
    with_case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        listed = written(s.agg(F.to_json(ordered(item)).alias("value")), "metadata")
    finally:
        spark.conf.set("spark.sql.caseSensitive", with_case)
    object_ = written(s.agg(F.to_json(F.struct(F.lit("m").alias("model"), ordered(F.concat(F.lit("w"), key)).alias("windows"))).alias("value")), "metadata")
    windows = s.filter("s_suppkey % 5 > 0").select(F.concat(F.lit("w"), key).alias("window_id"), F.concat(F.lit("IPR"), F.col("s_nationkey").cast("string")).alias("ipr_id"), name.alias("ipr_name"))
    read = lambda path, w: tables.read_index_metadata(spark, path, w).select("pos", "window_id", "ipr_id", "ipr_name")
    found = read(listed, None).withColumn("layout", F.lit("list")).union(read(object_, windows).withColumn("layout", F.lit("windows")))
    return found.select("layout", F.col("pos").cast("bigint").alias("pos"), "window_id", "ipr_id", "ipr_name")


@query(" SELECT protein_id, CAST(CASE WHEN start_ % 3 = 0 THEN NULL ELSE start_ END AS VARCHAR) AS start_, end_, CASE WHEN ipr_id = '-' THEN NULL ELSE ipr_id END AS ipr_id FROM hits", "hits")
def hits_table(spark, sf_dir):
    """SNK-01, SRC-09, SRC-10: a table written with its suffix forced, and read as texts with `.` and `-` as null."""
    h = made(Tables(spark, sf_dir), "hits").select("protein_id", F.when(F.col("start") % 3 == 0, ".").otherwise(F.col("start").cast("string")).alias("start"), "end", "ipr_id")
    path = writers.save_table(h, _folder(spark, "hits") + ".csv", single=False)
    return tables.read_hits(spark, path).withColumn("start", F.col("start").cast("string")).withColumnsRenamed({"start": "start_", "end": "end_"})


LETTERS = "ACDEFGHIKL"
LETTER_CODES = [ord(c) for c in LETTERS]


class LetterModel:
    """A protein model for queries: a residue's vector marks its letter."""

    def __call__(self, sequences):
        import numpy as np

        out = np.zeros((len(sequences), max(map(len, sequences), default=0) + 2, len(LETTERS)), np.float32)
        for i, s in enumerate(sequences):
            own = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            out[i, 1 : len(s) + 1] = own[:, None] == LETTER_CODES
            out[i, len(s) + 1 :] = 9  # what lies behind a sequence must not count
        return out


def _share_sql(s: str) -> str:
    """SQL of the share of each letter in a sequence."""
    return f"list_transform(string_split_regex('{LETTERS}', ''), lambda c: (length({s}) - length(replace({s}, c, ''))) / CAST(length({s}) AS DOUBLE))"


@query(f", h AS (SELECT split_part(protein_id, '.', 1) AS protein_id, start_, end_, coalesce(signature_accession, 'NA') AS s FROM hits WHERE end_ - start_ + 1 BETWEEN 30 AND 600), w AS (SELECT DISTINCT h.protein_id || ':' || start_ || '-' || end_ || ':' || s AS window_id, substr(sequence, CAST(greatest(1, start_ - 32) AS INT), CAST(least(length(sequence), end_ + 32) - greatest(1, start_ - 32) + 1 AS INT)) AS part FROM h JOIN proteins p ON p.protein_id = h.protein_id WHERE least(length(sequence), end_ + 32) >= greatest(1, start_ - 32)) SELECT window_id, i, round(x, 4) AS x FROM (SELECT window_id, unnest({_share_sql('part')}) AS x, CAST(unnest(range({len(LETTERS)})) AS INT) AS i FROM w)", "hits", "proteins")
def window_vectors(spark, sf_dir):
    """ML-02, ML-03, ARR-04: windows embedded by a model of residues, pooled over their own residues, not normalised."""
    t = Tables(spark, sf_dir)
    h = made(t, "hits").filter("end - start + 1 BETWEEN 30 AND 600").dropDuplicates(["protein_id", "start", "end", "signature_accession"])  # a window each; sequences don't move for it
    windows = retrieval.domain_windows(h, made(t, "proteins")).filter("length(sequence) > 0")
    found = retrieval.embed_windows(windows, embedding.Pooled(LetterModel, exact=True))
    return found.select("window_id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


@query(f", q AS (SELECT c_custkey AS id, repeat('{LETTERS}', CAST(c_custkey % 300 + 1 AS INT)) || repeat('A', CAST(c_nationkey * 20 AS INT)) AS s FROM customer), p AS (SELECT id, s, unnest(CASE WHEN length(s) > 1500 THEN range(0, greatest(0, CAST(ceil((length(s) - 1200) / 800.0) AS BIGINT)) + 1) ELSE [0] END) AS k FROM q), v AS (SELECT id, CASE WHEN length(s) > 1500 THEN substr(s, CAST(k * 800 + 1 AS INT), 1200) ELSE s END AS part FROM p), e AS (SELECT id, unnest({_share_sql('part')}) AS x, unnest(range({len(LETTERS)})) AS i FROM v), m AS (SELECT id, i, avg(x) AS x FROM e GROUP BY ALL) SELECT id, CAST(i AS INT) AS i, round(x / n, 4) AS x FROM m JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) USING (id)", "frag")
def whole_vectors(spark, sf_dir):
    """ML-01, ARR-01, ARR-04: sequences embedded whole, very long ones as the mean of their windows, of unit length."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a small file makes long sequences
    q = c.select(F.col("c_custkey").alias("id"), F.concat(F.repeat(F.lit(LETTERS), (F.col("c_custkey") % 300 + 1).cast("int")), F.repeat(F.lit("A"), (F.col("c_nationkey") * 20).cast("int"))).alias("s"))
    found = retrieval.embed_whole(q, ["id"], "s", embedding.Pooled(LetterModel, exact=True), CFG)
    return found.select("id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 4))
