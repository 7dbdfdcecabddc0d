"""Rules of the event engine on hand-made fixtures."""

import gzip

import numpy as np
import pytest

from chimerant.config import Config
from chimerant.operators import graph, joins, ranges, sets, sparse
from chimerant.plans import assemble, comparison, events, expression, features, lookups, peptides, retrieval, run, scoring
from chimerant.sources import tables, writers

GTF = """#comment
1\tx\tgene\t100\t400\t.\t+\t.\tgene_id "G1.1";
1\tx\tgene\t500\t900\t.\t+\t.\tgene_id "G2.4";
1\tx\tgene\t950\t990\t.\t-\t.\tgene_id "G3";
1\tx\tgene\t700\t800\t.\t-\t.\tgene_id "G4";
1\tx\ttranscript\t100\t400\t.\t+\t.\tgene_id "G1.1"; transcript_id "T1.2"; tag "basic"; tag "MANE_Plus_Clinical";
1\tx\ttranscript\t110\t400\t.\t+\t.\tgene_id "G1.1"; transcript_id "T3.2"; tag "MANE_Select";
1\tx\ttranscript\t500\t900\t.\t-\t.\tgene_id "G2.4"; transcript_id "T2.1";
1\tx\tCDS\t121\t150\t.\t+\t0\tgene_id "G1.1"; transcript_id "T1.2";
1\tx\tCDS\t201\t230\t.\t+\t0\tgene_id "G1.1"; transcript_id "T1.2";
1\tx\tCDS\t801\t830\t.\t-\t0\tgene_id "G2.4"; transcript_id "T2.1";
1\tx\tCDS\t701\t730\t.\t-\t0\tgene_id "G2.4"; transcript_id "T2.1";
1\tx\tthree_prime_utr\t231\t400\t.\t+\t.\tgene_id "G1.1"; transcript_id "T1.2";
1\tx\tfive_prime_utr\t100\t120\t.\t+\t.\tgene_id "G1.1"; transcript_id "T1.2";
1\tx\tfive_prime_utr\t850\t900\t.\t-\t.\tgene_id "G2.4"; transcript_id "T2.1";
1\tx\tCDS\tx\t730\t.\t-\t0\tgene_id "G2.4"; transcript_id "T2.1";
too\tfew
"""
EVENTS = "Gene1\tGene2\tChromosome1\tChromosome2\tBreakpoint1\tBreakpoint2\tFusionStrand1\tFusionStrand2\tGeneStrand1\tGeneStrand2\ttranscript_id1\ttranscript_id2\tnote\nA\tB\t1\t1\t205\t810\t+\t-\t+\t-\tT1\tT2\tNA\nA\tA\t1\tX\t160\t715\t-\t.\t+\t-\tT1\tT2\tx\nC\tD\t2\t2\t5\t6\t+\t+\t+\t+\t.\tT9\t\n"


@pytest.fixture(scope="module")
def ref(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ref")
    with gzip.open(d / "a.gtf.gz", "wt") as f:
        f.write(GTF)
    (d / "p.fa").write_text(">P1.1 x transcript:T1.2\nMABCDEFGHI\nKLMNOPQRS*\n>P2.1 transcript:T2.1\nMCCCCCCCCCDDDDDDDDDD\n>P3\nMM\n")
    (d / "events.csv").write_text(EVENTS)
    made = {k: v.cache() for k, v in lookups.gtf_lookups(tables.read_gtf(spark, str(d / "a.gtf.gz"))).items()}
    made |= lookups.fasta_lookups(tables.read_fasta(spark, str(d / "p.fa")))
    return d, made


def test_loader(spark, ref):
    df = tables.load_events(spark, str(ref[0] / "events.csv"))
    assert df.columns[:2] == ["gene1", "gene2"] and dict(df.dtypes)["chromosome1"] == "string" and dict(df.dtypes)["breakpoint1"] == "bigint"
    assert [r["note"] for r in df.collect()] == [None, "x", None]
    with pytest.raises(ValueError):
        tables.require(df, ["nope"])
    assert tables.snake("retained_5P_UTR1") == "retained_5_p_utr1" and tables.snake("FusionStrand1") == "fusion_strand1"
    assert tables.sniff(["a;b", "c;d"]) == ";" and tables.separator_of("a,b") == ","


def test_lookups(ref):
    made = ref[1]
    cds = {(r["transcript_id"], r["start"]): r["cumulative_length"] for r in made["cds_lookup"].collect()}
    assert cds == {("T1", 121): 30, ("T1", 201): 60, ("T2", 801): 30, ("T2", 701): 60}
    assert [(r["gene_id"], r["mane_transcript_id"], r["mane_tss"]) for r in made["mane_lookup"].collect()] == [("G1", "T3", 110)]
    assert {r["gene_id"]: r["next_gene_id"] for r in made["next_gene_lookup"].collect()} == {"G1": "G2", "G3": "G4"}
    assert {r["transcript_id"] for r in made["peptide_lookup"].collect()} == {"T1", "T2"} and made["protein_lookup"].count() == 3


@pytest.fixture(scope="module")
def built(spark, ref):
    d, made = ref
    return peptides.build(tables.load_events(spark, str(d / "events.csv")), made["peptide_lookup"], made["cds_lookup"]).cache()


def test_split(built):
    rows = {r["id"]: r for r in built.collect()}
    assert len(rows) == 3
    a = rows[1]  # (60 - 30 + 4) // 3 = 11 on plus; 830 - 810 = 20 // 3 = 6 on minus
    assert (a["retained_peptide1"], a["lost_peptide1"]) == ("MABCDEFGHIKL", "MNOPQRSX") and a["retained_peptide2"] == "MCCCCCC"
    assert a["retained_peptide2"] + a["lost_peptide2"] == "MCCCCCCCCCDDDDDDDDDD"
    assert rows[2]["retained_peptide1"] == "." and rows[3]["retained_peptide2"] == "." and rows[3]["protein_id"] == "."
    assert writers.fasta_records(built).count() == 6


def test_features_and_events(built, ref):
    made = ref[1]
    dom = built.selectExpr("*", "'.' AS lost_domains1", "'IPR000001' AS lost_domains2", "'Protein kinase domain' AS lost_domain_names1", "'Forkhead (FOX) DNA-binding domain' AS lost_domain_names2")
    f = features.compute(dom, made["all_features_lookup"], made["mane_lookup"], made["cds_lookup"])
    rows = {r["id"]: r for r in f.collect()}
    assert len(rows) == 3
    assert (rows[1]["wrong_tr_dir_5p"], rows[2]["wrong_tr_dir_5p"], rows[2]["wrong_tr_dir_3p"]) == (0, 1, 2)
    assert (rows[1]["truncated_5p"], rows[2]["truncated_5p"], rows[1]["retained_5P_UTR2"]) == (1, 0, 1) and rows[1]["retained_5P_UTR1"] == 0
    assert (rows[1]["frame1"], rows[1]["frame2"], rows[1]["out_of_frame1"]) == (1, 2, 1) and rows[2]["out_of_frame1"] == 2 and rows[2]["out_of_frame2"] == 2
    assert rows[1]["lost_kinases_key_doms1"] == 1 and rows[1]["lost_cancer_key_doms2"] == 0 and rows[1]["gene_id1"] == "G1"
    noted = events.annotate(f, made["all_features_lookup"], made["next_gene_lookup"])
    n = {r["id"]: r for r in noted.collect()}
    assert n[2]["same_gene_fusion"] == 1 and n[2]["same_gene_fusion_lost_dom"] == 1 and n[1]["read_through"] == 0
    total = {r["type"]: r["count"] for r in events.counts(noted).collect()}
    assert total["same_gene_fusion"] == 1 and total["none"] == 2 and list(total)[-1] == "none"


def test_promoter_and_read_through(spark, ref):
    made = ref[1]
    rows = [(1, "a", "b", "T1", "T2", "1", "1", 90, 450, "+", "+", "G1", "G2"), (2, "a", "b", "T1", "T2", "1", "1", 110, 450, "+", "+", "G1", "G2"), (3, "a", "b", "T1", "T2", "1", "1", 390, 880, "+", "+", "G1", "G2"), (4, "a", "b", "T1", "T2", "1", "2", 390, 880, "+", "+", "G1", "G2")]
    df = spark.createDataFrame(rows, "id long, gene1 string, gene2 string, transcript_id1 string, transcript_id2 string, chromosome1 string, chromosome2 string, breakpoint1 long, breakpoint2 long, gene_strand1 string, gene_strand2 string, gene_id1 string, gene_id2 string")
    out = {r["id"]: r for r in events.annotate(df, made["all_features_lookup"], made["next_gene_lookup"], Config(breakpoint_window=50)).collect()}
    assert out[1]["promoter_hijacking_500"] == 1 and out[2]["promoter_hijacking_500"] == 0 and out[2]["promoter_hijacking_utr"] == 1 and out[3]["promoter_hijacking"] == 0
    assert (out[3]["read_through"], out[3]["read_through_loose"], out[4]["read_through"], out[1]["read_through_loose"]) == (1, 1, 0, 0)


def test_true_fusion(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 0), (2, 2.0, 1.5, 0), (3, 9.0, 9.0, 1)], "id long, coverage1 double, coverage2 double, same_gene_fusion int")
    out = {r["id"]: r for r in events.true_fusions(df).collect()}
    assert out[1]["true_fusion_1.8"] == 1 and out[1]["true_fusion_2.0"] == 0 and out[2]["true_fusion_1.5"] == 0 and out[3]["true_fusion_1.5"] == 0


def test_comparison(spark):
    a = spark.createDataFrame([(1, "IPR000001 | IPR000002", ".", "-", None)], "id int, retained_domains1 string, lost_domains1 string, retained_domains2 string, lost_domains2 string")
    b = spark.createDataFrame([("1", "IPR000002|IPR000003|x", "IPR000001", ".", ".")], "id string, retained_domains1 string, lost_domains1 string, retained_domains2 string, lost_domains2 string")
    rows = {r["col"]: r for r in comparison.rows(a, b).collect()}
    r = rows["retained_domains1"]
    assert (r["n_ipro"], r["n_faiss"], r["precision"], r["jaccard"], r["missing_in_faiss"]) == (2, 2, 0.5, 0.333333, "IPR000001") and rows["lost_domains2"]["all_interpro_in_faiss"] == 1
    assert {x["col"] for x in comparison.stats(comparison.rows(a, b)).collect()} >= {"ALL_COLUMNS"}


def _page(first_channel_blue=True):
    """A page as drawn: two histograms of the signal's grey, markers, and an empty gap from 700 to 1000."""
    page = np.full((400, 1700, 3), 255, np.uint8)
    page[260:334, 220:700] = 100  # filled, but no signal
    page[260:334, 1000:1600] = 100
    page[314:334, 240:260] = 171  # 20 of 84 pixels high
    page[264:334, 500:510] = 160  # within the tolerance, 70 high
    page[324:334, 1300:1310] = 171
    for at in (400, 1200):
        page[250:334, at : at + 2] = (255, 0, 0) if first_channel_blue else (0, 0, 255)
    return page


def test_expression(spark):
    left, right = expression.halves_of(expression.ordered(_page()))
    assert left.shape == (84, 597, 3) and right.shape == (84, 1600 - 883, 3)  # the centre, 850, less and plus 33
    assert expression.blue_column(left) == 180 and expression.blue_column(right) == 1200 - 883
    assert expression.halves_of(np.zeros((400, 1700, 3), np.uint8)) is None and len(expression.analyse_page("x", np.zeros((400, 1700, 3), np.uint8))) == 0
    other = expression.analyse_page("p", _page(False), Config(parity=False))
    assert other.equals(expression.analyse_page("p", _page()))
    cols = spark.createDataFrame(other)
    ex = expression.exons(cols, spark.createDataFrame([("p", 84)], "page_id string, max_height int"))
    found = {(r["side"], r["half"], r["start"]): r["mean"] for r in ex.collect()}
    assert found == {(1, "L", 20): 20.0, (1, "R", 500 - 220 - 182): 70.0, (2, "R", 1300 - 883 - (1200 - 883) - 2): 10.0}
    pages = spark.createDataFrame([("p", "+", "-", "T1", None)], "page_id string, strand1 string, strand2 string, transcript_id1 string, transcript_id2 string")
    r = expression.coverage(ex, pages).first()
    assert (r["mean_retained1"], r["mean_lost1"], r["coverage1"], r["coverage2"]) == (20.0, 70.0, 0.286, 0.0)
    assert expression.widest_gap(np.array([True, False, False, True, False])) == (1, 2)


def test_retrieval_scoring_and_run(spark, ref, built):
    made = ref[1]
    hits = spark.createDataFrame([("P1.1", "X", "S1", 2, 9, None, "IPR000001", "one"), ("P2", "X", "S2", 1, 12, None, "IPR000002", "two"), ("P9", "X", "S3", 1, 12, None, "IPR000003", "three"), ("P2", "X", "S4", 1, 12, None, None, "none")], "protein_id string, analysis string, signature_accession string, start long, end long, feat_len long, ipr_id string, ipr_desc string")
    cfg = Config(min_length=5, context_left=2, context_right=2)
    proteins = made["protein_lookup"].withColumnRenamed("peptide_sequence", "sequence")
    merged = retrieval.merge_hits([hits], cfg)
    win = retrieval.domain_windows(merged, proteins, cfg)
    w = {r["window_id"]: r for r in win.collect()}
    assert w["P1:2-9:S1"]["window_start"] == 1 and w["P1:2-9:S1"]["window_end"] == 11 and len(w) == 2 and retrieval.missing_proteins(merged.filter("protein_id = 'P9'"), proteins) == 1
    index = retrieval.build_index(win, retrieval.kmer_embedder(), cfg).cache()
    found = retrieval.by_search(built, index, retrieval.kmer_embedder())
    r = {x["id"]: x for x in found.collect()}
    assert r[1]["retained_domains1"].split("|")[0] == "IPR000001" and r[1]["retained_domains2"].split("|")[0] == "IPR000002"
    noted = retrieval.by_annotator(built, lambda q: q.selectExpr("query", "'IPR000007' AS accession", "'seven' AS name"))
    assert {x["retained_domains1"] for x in noted.collect()} == {"IPR000007", "."}
    positives = spark.createDataFrame([("1", "Q", "R", "IPR000007", "IPR000007", "IPR000007", ".", "0", "0")], "id string, gene1 string, gene2 string, retained_domains1 string, lost_domains1 string, retained_domains2 string, lost_domains2 string, out_of_frame1 string, out_of_frame2 string")
    out = run.run(tables.load_events(spark, str(ref[0] / "events.csv")), made, positives, index=index)
    rows = out.complete.collect()
    assert len(rows) == 3 and all(0 <= x["driver_score"] <= 1 for x in rows)


def test_neighbours_and_evaluation(spark, monkeypatch):
    """The block product against all pairs, in one block and in many; diffusion on tables against the driver's; metrics."""
    rng = np.random.default_rng(2)
    rows = [(i, f"t{t}", float(w)) for i in range(40) for t, w in zip(rng.choice(30, 6, False), rng.random(6), strict=True)]
    feats = spark.createDataFrame(rows, "row long, token string, weight double")
    m = np.zeros((40, 30))
    for i, t, w in rows:
        m[i, int(t[1:])] = w
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims, near = np.round(m @ m.T, 6), {}
    for i in range(40):
        for j in sorted(range(40), key=lambda j: (-sims[i, j], j))[:5]:
            for pair in ((i, j), (j, i)):
                near[pair] = near.get(pair, 0) + sims[i, j] / 2
    want = {p: w for p, w in near.items() if p[0] != p[1] and w > 0}
    for size in (1_024, 7):
        near_lists, counts = sparse.cosine_lists(feats, 5, size)
        got = {(r.src, r.dst): r.w for r in graph.symmetrise(near_lists.selectExpr("row AS src", "other AS dst", "w")).collect()}
        assert counts["rows"] == 40 and counts["pairs"] == 1_600
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    p = graph.row_stochastic(scoring.neighbours(feats, 5))
    seeds = spark.range(40).selectExpr("id AS node", "double(id < 3) AS y")
    here = {r.node: r.s for r in graph.diffuse(p, seeds, 0.5, 6).collect()}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 1)
    there = {r.node: r.s for r in graph.diffuse(p, seeds, 0.5, 6).collect()}
    assert here.keys() == there.keys() and all(abs(here[n] - there[n]) < 1e-9 for n in here)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 1_000_000)
    cells = "id string, gene1 string, gene2 string, retained_domains1 string, lost_domains1 string, retained_domains2 string, lost_domains2 string, out_of_frame1 string"
    table = lambda a, b: spark.createDataFrame([(str(i), f"A{i}", f"B{i}", f"IPR{i % 4:06}", ".", f"IPR{i % 3:06}", ".", "0") for i in range(a, b)], cells)
    out, held, metrics = scoring.evaluate(table(0, 12), table(12, 24))
    assert out.count() == 12 and held.count() == 3 and [r.k for r in metrics.collect()] == [10, 24, 24] and all(0 <= r.recall_at_k <= 1 for r in metrics.collect())


def test_graph_properties(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(5)]) for i in range(30)], "id long, vec array<double>")
    edges = graph.knn_graph(v, 5).collect()
    w = {(r["src"], r["dst"]): r["w"] for r in edges}
    assert all(a != b and w[(b, a)] == pytest.approx(x) for (a, b), x in w.items())
    sums = graph.row_stochastic(graph.knn_graph(v, 5)).groupBy("src").sum("w").collect()
    assert all(r[1] == pytest.approx(1) for r in sums)


def test_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    more = spark.createDataFrame([(1, "z", 5)], "id long, x string, y int")
    assert sorted(tuple(r) for r in joins.additive(df, more).collect()) == [(1, "a", 5), (2, "b", None)]
    assert sorted(tuple(r) for r in joins.additive(df, more, prefer="last").select("id", "x").collect()) == [(1, "z"), (2, None)]
    assert joins.is_unique(df) and not joins.is_unique(df.union(df))
    assert [r["id"] for r in ranges.numbered(spark.range(10).withColumnRenamed("id", "v").repartition(3), ["v"]).orderBy("v").collect()] == list(range(1, 11))
    assert sets.union_all(df, more).count() == 3
    assert scoring.split_holdout(10) == scoring.split_holdout(10) and len(scoring.split_holdout(10)[1]) == 2
    assert writers.stage_path("o", "x/y_domains_full.tsv", "scores", "tsv") == "o/y_scores.tsv"
    with pytest.raises(ValueError):
        assemble.complete(df.union(df), df, df, df, df)


def test_streams(spark, tmp_path):
    from chimerant.streaming import intake

    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 02:00:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) AS t")
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.table_stream(spark, str(tmp_path / "in"), df.schema, files=1)
    assert {tuple(r) for r in intake.drain(intake.running_counts(stream, "k"), "running").collect()} == {("a", 2), ("b", 1)}
    assert intake.drain(intake.windowed_counts(stream, "t", "k"), "windowed").count() == 2
    assert intake.drain(intake.sessions(stream, "t", "k"), "sessions").count() == 2
    seen = []
    intake.each_batch(stream, lambda b, i: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 3
