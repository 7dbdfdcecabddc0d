"""What queries move and how many jobs they take doesn't grow with pairs, batches or pixels."""

import glob
import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from chimerant.operators import graph, vectors
from chimerant.plans import batches, raster, retrieval


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_f1_waves_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "WAVES", 2)
    queries = spark.range(40).selectExpr("format_string('q%03d', id) AS query", "'AC' AS sequence")
    found = batches.annotate_in_batches(queries, lambda rows: rows.assign(accession="A", name="n"), str(tmp_path / "ledger"), 1, wave=4)
    assert found.count() == 40 and len(glob.glob(str(tmp_path / "ledger" / "wave-*"))) == 2


def test_f2_pixels_are_no_rows(spark):
    pages = spark.createDataFrame([("a", y, [0] * 300) for y in (250, 251)] + [("b", 250, [0xFFFFFF] * 230), ("c", 250, [0] * 9)], raster.RASTER)
    found = raster.profiles(pages)
    assert "Generate" not in plan(found)
    assert {r.page_id: (len(r.profile), r.profile[0].mean) for r in found.collect()} == {"a": (80, 0.0), "b": (10, 255.0)}


def test_f4_a_small_graph_has_few_buckets(spark):
    edges = spark.range(20).selectExpr("id AS src", "(id + 1) % 20 AS dst", "double(1) AS w")
    seeds = spark.range(20).selectExpr("id AS node", "double(id = 0) AS y")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = graph.diffuse_bucketed(edges, seeds, 0.5, 3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64" and len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert found.count() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_f3_f4_steps_over_packed_edges_write_nothing(spark, monkeypatch):
    edges = spark.range(3_000).selectExpr("pmod(hash(id), 101) AS src", "pmod(hash(id, 1), 103) AS dst", "1 / (2 + id % 7) AS w").groupBy("src", "dst").agg(F.avg("w").cast("double").alias("w"))
    seeds = spark.range(102).selectExpr("100 - id AS node", "double(id % 3 = 0) AS y").filter("node <> 7")  # some ends are no nodes
    p = graph.row_stochastic(edges)
    want = {r.node: r.s for r in graph._diffuse_local(p, seeds, 0.9, 30, 1e-6).collect()}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 100)
    monkeypatch.setattr(graph, "PIECE_EDGES", 50)
    tables = []
    monkeypatch.setattr(graph, "bucketed", lambda df, name, by, plain=graph.bucketed: tables.append(name) or plain(df, name, by))
    got = {r.node: r.s for r in graph.diffuse(p, seeds, 0.9, 30).collect()}
    assert not tables and got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    monkeypatch.setattr(graph, "LOCAL_NODES", 10)
    far = {r.node: r.s for r in graph.diffuse(p, seeds, 0.9, 3).collect()}
    assert tables and far.keys() == want.keys()


def test_f5_equal_fragments_are_searched_once(spark, monkeypatch):
    asked = []
    plain = vectors.search
    monkeypatch.setattr(retrieval, "search", lambda q, *a, **k: asked.append(q.count()) or plain(q, *a, **k))
    columns = ["retained_peptide1", "lost_peptide1", "retained_peptide2", "lost_peptide2"]
    events = spark.range(30).select("id", *(F.lit("AC" if i % 2 else "AAD").alias(c) for i, c in enumerate(columns)))
    index = spark.createDataFrame([(i, f"IPR{i}", "n", [float(i == j) for j in range(64)]) for i in range(64)], "pos long, ipr_id string, ipr_name string, vec array<float>")
    rows = retrieval.by_search(events, index, retrieval.kmer_embedder()).collect()
    assert asked == [2] and len(rows) == 30 and all(r.retained_domains1.count("|") == 7 for r in rows)


def test_f6_values_at_a_bound(spark, tmp_path):
    from chimerant.plans import catalog

    values = [15.3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, -14.9, 0.0, 0.0, 0.0]
    mean = -0.0  # the last values bring the mean to 0.1 - 0.0 for each permutation
    values[-3:] = [0.1 * len(values) - round(sum(values[:-3]), 4) + mean, 0.0, 0.0]
    spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{i:02}", "a", round(v, 4)) for i, v in enumerate(values)], "event_id long, user_id long, ts string, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    exact = [abs(round(v * 10_000) * len(values) - sum(round(x * 10_000) for x in values)) <= 150_000 * len(values) for v in values]
    got = {r.event_id: r.loose for r in catalog.adjacency_loose(spark, str(tmp_path)).collect()}
    assert got == {i: int(exact[i] and i + 1 < len(values) and exact[i + 1]) for i in range(len(values))}


def test_f10_to_f14_hits_grow_with_queries(spark, monkeypatch):
    kept = {}
    plain = vectors.stored

    def note(df, name):
        table = plain(df, name)
        kept[name] = kept.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(vectors, "stored", note)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)], "id long, vec array<double>")
    hits, counts = vectors.bounded_search(df, df, 3, rows=16, chunk=50)
    assert hits.count() == 1_800 and counts["visited"] > 180_000  # bounds rule out little, and yet
    assert sum(kept.values()) <= 600 + 600 * 3 + 24  # the index, three items of each query, and a count of each task


def test_f15_f16_vectors_do_not_move(spark):
    df = spark.createDataFrame([(1, "A" * 3_000), (2, "AC")], "id long, s string")
    assert "Exchange" not in plan(retrieval.embed_whole(df, ["id"], "s", retrieval.kmer_embedder()))
    windows = spark.createDataFrame([("w", "i", "n", "ACD")], "window_id string, ipr_id string, ipr_name string, sequence string")
    assert "Exchange" not in plan(retrieval.embed_windows(windows, retrieval.kmer_embedder()))
