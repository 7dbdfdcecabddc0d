"""Published example runs, replayed stage by stage where a folder of their outputs lies beside the repository; else skipped.

Stages whose lookups are not published (peptides from transcripts, UTRs, MANE, adjacency, driver scores) can't be replayed:
mini fixtures and the queries' SQL stand for those.
"""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chimerant.config import DOMAIN_COLUMNS
from chimerant.operators.joins import additive
from chimerant.plans import assemble, comparison, events, expression, features
from chimerant.sources import tables, writers

ROOT = Path(os.environ.get("CHIMERANT_GOLDENS", Path(__file__).resolve().parents[2] / "reference" / "output"))
#: The example run is the one whose domains were compared.
RUN = next((p.name.removesuffix("_comparison_rows.tsv") for p in sorted(ROOT.rglob("*_comparison_rows.tsv"))), "") if ROOT.is_dir() else ""
pytestmark = pytest.mark.skipif(not ROOT.is_dir(), reason="no folder of published outputs")


def path_of(kind, name=RUN, suffix="tsv"):
    """The one file of a stage, wherever the run has put it."""
    found = list(ROOT.rglob(f"{name}_{kind}.{suffix}"))
    if len(found) != 1:
        pytest.skip(f"no {kind}")
    return str(found[0])


def raw(kind, name=RUN):
    """Rows as texts."""
    with open(path_of(kind, name), newline="") as f:
        return list(csv.DictReader(f, delimiter="\t"))


def table(spark, kind, name=RUN):
    return tables.load_table(spark, path_of(kind, name))


def same(got, want):
    """Equal texts, or numbers within 1e-9; empty stands for null, and true for True."""
    got = "" if got is None else str(got)
    if got == want or got.lower() == want.lower():
        return True
    try:
        return abs(float(got) - float(want)) < 1e-9
    except ValueError:
        return False


def equal(df, want, key):
    rows = {tuple(str(r[k]) for k in key): r.asDict() for r in df.collect()}
    assert len(rows) == len(want)
    for w in want:
        r = rows[tuple(w[k] for k in key)]
        assert [(c, r[c], w[c]) for c in w if not same(r[c], w[c])] == []


def compared(spark):
    return comparison.rows(table(spark, "ips_only"), table(spark, "domains"))


def test_comparison_rows(spark):
    want = raw("comparison_rows")
    assert len(want) == 16
    equal(compared(spark), want, ["id", "col"])


def test_comparison_stats(spark):
    equal(comparison.stats(compared(spark)), raw("comparison_stats"), ["col"])


@pytest.mark.parametrize("domains,full", [("domains", "domains_full"), ("ips_only", "ips_full")])
def test_domains_join_peptides(spark, domains, full):
    """Retrieval's and the annotator's hand-off."""
    out = additive(table(spark, "peptides"), table(spark, domains))
    want = raw(full)
    assert out.columns == list(want[0])
    equal(out, want, ["id"])


def runs_with_fasta():
    return sorted(p.name.removesuffix("_peptides.tsv") for p in ROOT.rglob("*_peptides.tsv") if p.with_suffix(".fasta").exists()) or [RUN]


@pytest.mark.parametrize("name", runs_with_fasta())
def test_fasta_of_fragments(spark, name):
    records = writers.fasta_records(table(spark, "peptides", name)).select("value").collect()
    text = Path(path_of("peptides", name, "fasta")).read_text()
    want = [r.split("\n", 1) for r in text.lstrip(">").split("\n>")]
    got = [r.value.removeprefix(">").split("\n", 1) for r in records]
    clean = lambda rows: sorted((h.strip(), s.replace("\n", "")) for h, s in rows)
    assert clean(got) == clean(want) and len(got) > 10


def test_strand_and_domain_flags(spark):
    df = features.domains_lost(features.strand_coherence(features.with_defaults(table(spark, "domains_full"))))
    want = raw("features")
    flags = [c for c in want[0] if c.startswith(("wrong_tr_dir", "lost_")) and c.endswith(("p", "doms1", "doms2"))]
    assert len(flags) == 12
    equal(df.select("id", *flags), [{c: w[c] for c in ["id", *flags]} for w in want], ["id"])


def test_frames_of_pairs(spark):
    df = table(spark, "features").withColumns({f"frame{s}": F.col(f"frame{s}").cast("double").cast("bigint") for s in (1, 2)} | {f"coding_bp{s}": F.col(f"coding_bp{s}").cast("boolean") for s in (1, 2)})
    names = ["in_frame", "out_of_frame_pair", "out_of_frame1", "out_of_frame2"]
    equal(features.pair_frames(df.drop(*names)).select("id", *names), [{c: w[c] for c in ["id", *names]} for w in raw("features")], ["id"])


def test_event_flags_and_coverage_defaults(spark):
    want = raw("annotated")
    mine = ["same_gene_fusion", "same_gene_fusion_lost_dom", "coverage1", "coverage2", *(c for c in want[0] if c.startswith("true_fusion"))]
    df = table(spark, "features")
    df = df.withColumns({c: F.col(c).cast("int") for c in df.columns if c.startswith(("read_through", "promoter_", "same_gene"))})
    out = events.true_fusions(events.same_gene(df))
    equal(out.select("id", *[f"`{c}`" for c in mine]), [{c: w[c] for c in ["id", *mine]} for w in want], ["id"])


def test_event_counts(spark):
    df = table(spark, "annotated")
    out = events.counts(df.withColumns({c: F.col(f"`{c}`").cast("int") for c in df.columns if c.startswith(("true_fusion", "promoter_", "read_through", "same_gene"))}))
    assert [(r["type"], str(r["count"])) for r in out.collect()] == [(w["type"], w["count"]) for w in raw("event_counts")]


def page_records(spark):
    found = [p for p in ROOT.rglob("*.json") if "jsons" in p.parts]
    if not found:
        pytest.skip("no page records")
    return [str(p) for p in found]


def test_coverage_of_pages(spark):
    found = page_records(spark)
    assert spark.read.option("multiLine", True).schema(tables.PAGE_RECORD).json(found).count() == 8
    out = tables.read_page_records(spark, found)
    assert out.count() == 4  # each event twice
    for s in (1, 2):
        out = expression.with_ratio(out.withColumnRenamed(f"coverage{s}", f"want{s}"), s)
    rows = out.collect()
    assert [(r.coverage1, r.coverage2) for r in rows] == [(r.want1, r.want2) for r in rows] and any(r.coverage1 > 0 for r in rows)


def test_complete_table(spark):
    want = raw("complete_analysis")
    cells = [f"{c}{s}" for s in (1, 2) for c in ("mean_retained", "mean_lost", "median_retained", "median_lost", "coverage")]
    pages = tables.read_page_records(spark, page_records(spark)).select(*assemble.KEYS, *cells)
    out = assemble.complete(*(table(spark, k) for k in ("peptides", "domains_full", "features", "annotated", "scores")), pages)
    assert len(want[0]) == 92 and set(out.columns) >= set(want[0])
    equal(out.select(*[f"`{c}`" for c in want[0]]), want, ["id"])
    own = [c for c in out.columns if c in want[0]]
    assert own == list(want[0])


def test_headers_in_snake_case(spark):
    with open(path_of("features")) as f:
        header = f.readline().rstrip("\n").split("\t")
    want = list(raw("annotated")[0])
    assert [tables.snake(c) for c in header] == want[: len(header)]
    assert set(DOMAIN_COLUMNS) <= set(want)
