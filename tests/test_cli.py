"""Commands from end to end: plot pages in a run, index building by steps, models as plug-ins, evaluation, exit codes."""

import json

import numpy as np
import pytest
from test_engine import ref  # noqa: F401 - the fixture of lookups

from chimerant import cli
from chimerant.plans import embedding, retrieval
from chimerant.sources import matrix, tables, writers

CELLS = ["id", "gene1", "gene2", "retained_domains1", "lost_domains1", "retained_domains2", "lost_domains2"]


@pytest.fixture(scope="module")
def setup(spark, ref, tmp_path_factory):  # noqa: F811
    d, made = ref
    out = tmp_path_factory.mktemp("cli")
    for name, df in made.items():
        if name.endswith("_lookup"):
            df.write.parquet(str(out / "lookups" / name))
    (out / "positives.tsv").write_text("\n".join("\t".join(r) for r in (CELLS, *([str(i), f"A{i}", "B", ".", f"IPR{i % 3:06}", ".", "."] for i in range(10)))) + "\n")
    (out / "hits.tsv").write_text("\t".join(["1|lost_peptide1", *["x"] * 10, "IPR000001", "Protein kinase domain", "-", "-"]) + "\n")
    return d, made, out


def events(setup):
    return str(setup[0] / "events.csv")


def unpng(data):
    """The pixels of a PNG as it is written here."""
    import struct
    import zlib

    assert data.startswith(b"\x89PNG") and data[12:16] == b"IHDR"
    width, height = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, 1 + 3 * width)
    assert zlib.crc32(data[37 : 41 + size]) == struct.unpack(">I", data[41 + size : 45 + size])[0] and not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, 3)


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Id\tCount\tShare\tflag\ttext\tchromosome1\tempty\tmixed\n1\t5\t0.5\ttrue\tx\t1\tNA\t1\n2\tNA\t1e3\tFALSE\ty\t2\t\t2\n3\t-7\t2\ttrue\t7\t3\tNA\tx1\n")
    df = tables.load_table(spark, str(tmp_path / "a.tsv"), infer=True)
    assert dict(df.dtypes) == {"id": "bigint", "count": "bigint", "share": "double", "flag": "boolean", "text": "string", "chromosome1": "string", "empty": "string", "mixed": "string"}
    assert [tuple(r)[1:4] for r in df.orderBy("id").collect()] == [(5, 0.5, True), (None, 1000.0, False), (-7, 2.0, True)]
    assert dict(tables.load_table(spark, str(tmp_path / "a.tsv")).dtypes)["count"] == "string"


def test_files_of_any_store_are_cleared(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for p in ("a/x", "a/b/y"):
        (tmp_path / p).write_text("z")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.clear.link./in", f"file://{tmp_path}")
    assert writers.clear_files("viewfs://clear/in/a", spark) == 2 and (tmp_path / "a/b").is_dir() and not list(tmp_path.rglob("[xy]"))
    assert writers.clear_files(str(tmp_path / "none"), spark) == 0


def test_plot_pages_in_a_run(spark, setup, tmp_path):
    d, made, out = setup
    row = tables.load_events(spark, events(setup)).collect()[0]
    docs = tmp_path / "docs"
    docs.mkdir()
    text = f"{row.gene1} {row.gene2}\n{row.transcript_id1}\nchr{row.chromosome1}:{row.breakpoint1}\nchr{row.chromosome2}:{row.breakpoint2}\nheight 84\n{row.transcript_id2}"
    real = text.replace(row.transcript_id1, "ENST1").replace(row.transcript_id2, "ENST2")
    (docs / "a.pdf").write_bytes(f"20 40 60 30|{real}\f10 10 10 10|nothing here".encode())
    (docs / "broken.pdf").write_bytes(b"no page")
    (tmp_path / "symbols.txt").write_text(f"{row.gene1}\n{row.gene2}\n")
    (tmp_path / "events.csv").write_text((d / "events.csv").read_text().replace(row.transcript_id1, "ENST1").replace(row.transcript_id2, "ENST2"))
    for name in ("peptide_lookup", "cds_lookup", "all_features_lookup", "mane_lookup", "next_gene_lookup"):
        df = made[name]
        if "transcript_id" in df.columns:
            df = df.replace({"T1": "ENST1", "T2": "ENST2"}, subset=["transcript_id"])
        df.write.parquet(str(tmp_path / "lookups" / name))
    args = ["run", "--input", str(tmp_path / "events.csv"), "--lookups", str(tmp_path / "lookups"), "--positives", str(out / "positives.tsv"), "--ips", "--annotations", str(out / "hits.tsv"), "--out", str(tmp_path / "out")]
    assert cli.main([*args, "--arriba", str(docs), "--renderer", "tests.opener:pages", "--symbols", str(tmp_path / "symbols.txt"), "--delinter", "--pictures"]) == 0
    pictures = sorted((tmp_path / "out/expression/pictures").glob("*.png"))
    assert [p.name for p in pictures] == ["a.pdf_0.png", "a.pdf_1.png"]
    image = unpng(pictures[0].read_bytes())
    assert image.shape == (84, 597 + 20 + 717, 3)  # both histograms and the gap
    assert (image[:, 180:182] == (0, 0, 255)).all() and (image[:, 20] == (0, 255, 0)).all() and (image[:, 597:617] == 255).all()
    assert not [p for p in (tmp_path / "out" / "interim").rglob("*") if p.is_file()]
    found = {r.id: r for r in tables.load_table(spark, str(tmp_path / "out/final/events_complete_analysis.tsv")).collect()}
    assert len(found) == 3
    one = found[1]
    got = [float(one[c]) for c in ("mean_retained1", "mean_lost1", "mean_retained2", "mean_lost2")]
    assert sorted(got) == [20.0, 30.0, 40.0, 60.0] and set(got[:2]) == {20.0, 40.0}
    assert float(one["coverage1"]) == pytest.approx(round(got[0] / got[1], 3)) and float(one["driver_score"]) >= 0
    assert found[2]["mean_retained1"] is None
    records = [json.loads(line) for p in (tmp_path / "out/expression/pages").glob("*.json") for line in p.read_text().splitlines()]
    assert len(records) == 2 and {r.get("max_height") for r in records} == {84, None}


def test_index_by_steps_and_search_in_it(spark, setup, tmp_path):
    d, made, out = setup
    hits = "protein_id\tanalysis\tsignature_accession\tstart\tend\tipr_id\tipr_desc\n" + "".join(f"P{i}\tX\tS{i}\t1\t{40 + i}\tIPR00000{i}\tname {i}\n" for i in range(1, 6)) + "P9\tX\tS9\t1\t5\tIPR000009\tshort\n"
    (tmp_path / "hits.tsv").write_text(hits)
    rng = np.random.default_rng(1)
    (tmp_path / "p.fa").write_text("".join(f">P{i}.1 x\n{''.join(rng.choice(list('ACDEFGHIKLMNPQRSTVWY'), 70))}\n" for i in range(1, 6)))
    folder = str(tmp_path / "index")
    base = ["rebuild-index", "--name", "flat", "--out", folder, "--model", "tests.opener:model"]
    assert cli.main([*base, "--all", "--hits", str(tmp_path / "hits.tsv"), "--proteome", str(tmp_path / "p.fa"), "--metric", "l2"]) == 0
    first = [r.vec for r in matrix.read_vectors(spark, f"{folder}/flat").orderBy("pos").collect()]
    assert len(first) == 5 and matrix.index_metric(spark, f"{folder}/flat") == "l2" and matrix.index_metric(spark, f"{folder}/embeddings") is None
    windows = {r.window_id: r.sequence for r in spark.read.parquet(f"{folder}/windows").collect()}
    meta = {r.pos: r for r in spark.read.parquet(f"{folder}/metadata").collect()}
    model = embedding.plugin("tests.opener:model")()
    for pos, r in meta.items():
        s = windows[r.window_id]
        assert np.allclose(first[pos], model([s])[0, 1 : 1 + len(s)].mean(0), atol=1e-5)  # not normalised, own residues only
    assert cli.main([*base, "--embeddings"]) == 0 and cli.main([*base[:2], "again", *base[3:], "--index", "--metric", "ip"]) == 0
    assert [r.vec for r in matrix.read_vectors(spark, f"{folder}/again").orderBy("pos").collect()] == first and matrix.index_metric(spark, f"{folder}/again") == "ip"
    with pytest.raises(ValueError, match="plain"):
        cli.main([*base[:2], "a/b", *base[3:], "--index"])
    args = ["stage", "domains", str(tmp_path / "x_peptides.tsv"), "--index", f"{folder}/flat", "--metadata", f"{folder}/metadata", "--out", str(tmp_path / "out")]
    peptides = spark.createDataFrame([(1, windows[meta[2].window_id], ".", windows[meta[0].window_id], ".")], "id long, retained_peptide1 string, lost_peptide1 string, retained_peptide2 string, lost_peptide2 string")
    writers.save_table(peptides, str(tmp_path / "x_peptides.tsv"))
    assert cli.main([*args, "--model", "tests.opener:model"]) == 0
    got = tables.load_table(spark, str(tmp_path / "out/x_domains.tsv")).collect()[0]
    assert len(got["retained_domains1"].split("|")) == 5
    with pytest.raises(ValueError, match="64"):
        cli.main(args)  # k-mers are no vectors of that index


def test_pooling_of_residues():
    exact, padded = embedding.Pooled("tests.opener:model"), embedding.Pooled("tests.opener:model", exact=False)
    alone, together = exact(["MKV"]), exact(["MKV", "MKVAAAAAAA", ""])
    assert np.array_equal(alone[0], together[0]) and not together[2].any() and embedding.width(exact) == 7
    assert np.array_equal(padded(["MKV"]), alone) and not np.array_equal(padded(["MKV", "MKVAAAAAAA"])[0], alone[0])
    with pytest.raises(ValueError, match="the model gave"):
        embedding.Pooled(lambda: lambda s: np.zeros((len(s), 1, 4)))(["MKV"])
    with pytest.raises(ValueError, match="module:function"):
        embedding.plugin("nothing")


def test_long_sequences_are_means_of_their_windows(spark):
    from chimerant.config import Config

    cfg = Config()
    rng = np.random.default_rng(3)
    s = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 3_100))
    embedder = embedding.Pooled("tests.opener:model")
    df = spark.createDataFrame([(1, s), (2, s[:1_500]), (3, "")], "id long, s string")
    got = {r.id: np.array(r.vec) for r in retrieval.embed_whole(df, ["id"], "s", embedder, cfg).collect()}
    starts = range(0, 3_100 - cfg.window_size + cfg.window_step, cfg.window_step)
    parts = embedder([s[a : a + cfg.window_size] for a in starts])
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    assert len(parts) == 4 and np.allclose(got[1], unit(parts.mean(0)), atol=1e-5)
    assert np.allclose(got[2], unit(embedder([s[:1_500]])[0]), atol=1e-5) and not got[3].any()


def test_evaluation_by_command(spark, setup, tmp_path):
    out = setup[2]
    cells = ["id", "gene1", "gene2", "retained_domains1", "lost_domains1", "retained_domains2", "lost_domains2", "out_of_frame1", "out_of_frame2"]
    (tmp_path / "x_annotated.tsv").write_text("\n".join("\t".join(r) for r in (cells, *([str(i), f"E{i}", "F", ".", f"IPR{i % 4:06}", ".", ".", "0", "0"] for i in range(8)))) + "\n")
    assert cli.main(["stage", "scores", str(tmp_path / "x_annotated.tsv"), "--positives", str(out / "positives.tsv"), "--evaluate", "--out", str(tmp_path / "out")]) == 0
    scores, held = (tables.load_table(spark, str(tmp_path / "out" / f"x_{k}.tsv")).collect() for k in ("scores", "holdout_scores"))
    assert len(scores) == 8 and len(held) == 2 and all(0 <= float(r["driver_score"]) <= 1 for r in [*scores, *held])
    assert [r["k"] for r in tables.load_table(spark, str(tmp_path / "out/pu_metrics.tsv")).collect()] == ["10", "18", "18"]


def test_lookup_commands_and_exit_codes(spark, setup, tmp_path, capsys):
    d, _, out = setup
    for kind, source in (("gtf", "a.gtf.gz"), ("fasta", "p.fa")):
        args = [f"{kind}-lookups", "--input", str(d / source), "--name", "n", "--out", str(tmp_path)]
        assert cli.main(args) == 0
        with pytest.raises(Exception, match="(?i)exists"):
            cli.main(args)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["n_all_features_lookup", "n_cds_lookup", "n_clean_fasta", "n_mane_lookup", "n_next_gene_lookup", "n_peptide_lookup", "n_protein_lookup"]
    a = tmp_path / "a.tsv"
    a.write_text("\t".join(CELLS) + "\n1\tx\ty\tIPR000001\t.\t.\t.\n")
    (tmp_path / "b.tsv").write_text("\t".join(CELLS) + "\n2\tx\ty\tIPR000001\t.\t.\t.\n")
    compare = lambda *x: cli.main(["compare", *x, "--out_rows", str(tmp_path / "rows"), "--out_stats", str(tmp_path / "stats")])
    assert compare("--ips", str(a), "--faiss", str(a)) == 0 and tables.load_table(spark, str(tmp_path / "rows/a_comparison_rows.tsv")).count() == 4
    assert compare("--ips", str(a), "--faiss", str(tmp_path / "b.tsv")) == 4
    assert compare("--ips", str(a), "--faiss", str(a), "--id-col", "nope") == 2
    with pytest.raises(SystemExit):
        cli.main(["run", "--faiss", "--ips", "--input", "x", "--lookups", "y", "--positives", "z"])


def test_second_delimiter_and_readers_of_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene1,gene2\tx\nA,B\n")  # as many tabs as commas: a tab table of two columns
    assert tables.load_table(spark, str(tmp_path / "a.csv")).columns == ["gene1,gene2", "x"]
    (tmp_path / "b.csv").write_text("a\tb\tc\n1,2\n")
    (tmp_path / "one.csv").write_text("only\nv\n")
    assert tables.load_table(spark, str(tmp_path / "one.csv")).columns == ["only"]
    (tmp_path / "hits.tsv").write_text("protein_id\tstart\tend\tipr_id\nP1\t1\tx\t-\nP2\t.\t9\tIPR1\n")
    assert [(r.protein_id, r.start, r.end, r.ipr_id) for r in tables.read_hits(spark, str(tmp_path / "hits.tsv")).collect()] == [("P1", 1, None, None), ("P2", None, 9, "IPR1")]
    (tmp_path / "m.json").write_text(json.dumps({"model": "m", "windows": ["w2", "w1", "w9"]}))
    windows = spark.createDataFrame([("w1", "IPR1", "a"), ("w1", "IPR2", "b"), ("w2", None, None)], "window_id string, ipr_id string, ipr_name string").coalesce(1)
    assert [(r.pos, r.window_id, r.ipr_id, r.ipr_name) for r in tables.read_index_metadata(spark, str(tmp_path / "m.json"), windows).orderBy("pos").collect()] == [(0, "w2", ".", ""), (1, "w1", "IPR2", "b"), (2, "w9", ".", "")]
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(7):
        (folder / f"d{i}.pdf").write_bytes(b"x")
    (folder / "no.txt").write_text("x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    assert len(names(tables.list_documents(spark, str(folder)))) == 7 and names(tables.list_documents(spark, str(folder), batch=2, size=3)) == ["d3.pdf", "d4.pdf", "d5.pdf"]
    assert writers.save_table(windows, str(tmp_path / "t.csv")).endswith("/t.tsv") and (tmp_path / "t.tsv").is_dir()
    assert [r.value for r in writers.fasta_records(spark.createDataFrame([(1, "MK", ".", None, "")], "id long, retained_peptide1 string, lost_peptide1 string, retained_peptide2 string, lost_peptide2 string"), long_header=False).collect()] == [">1|retained_peptide1\nMK"]
    writers.save_json(windows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    with pytest.raises(ValueError):
        writers.plain_name("a/b")
    assert writers.stage_path("o", "x/y_domains_full_features.tsv", "scores", ".tsv") == "o/y_scores.tsv"
