"""Numbers, ranks, running totals and searches by bounds at sizes where ranges and blocks are many."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from chimerant.operators import graph, ranges, sparse, vectors
from chimerant.plans import lookups
from chimerant.sources import tables


@pytest.mark.parametrize("rows,order", [(100_000, ["k"]), (20_000, None), (30_000, ["few"])])
def test_numbers_are_each_given_once(spark, rows, order):
    df = spark.range(rows).select((F.hash("id") % 40_000).alias("k"), (F.col("id") % 3).alias("few"), F.concat(F.lit("payload"), "id").alias("p"), "id").withColumnRenamed("id", "v").repartition(7)
    n = ranges.numbered(df, order)
    found = n.agg(F.countDistinct("id"), F.min("id"), F.max("id"), F.count("p"), F.countDistinct("v")).first()
    assert tuple(found) == (rows, 1, rows, rows, rows)
    if order:
        pdf = n.orderBy("id").toPandas()
        assert pdf[order[0]].is_monotonic_increasing


def test_a_value_of_most_rows_is_dealt_to_several_ranges(spark):
    sizes = ranges.ordered(spark.range(40_000).selectExpr("0 AS k", "id AS v"), ["k"], 8).groupBy(ranges.PART).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 20_000


def test_ranks_and_running_totals_at_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("row"), (F.hash("id") % 1_000).cast("double").alias("score"), (F.hash("id", F.lit(1)) % 5).alias("x"), F.lit("payload").alias("p"))
    r = graph.ranked(df, "score", "row")
    assert tuple(r.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()) == (1_000_000, 1, 1_000_000)
    pdf = r.toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["score", "row"], ascending=[False, True])
    assert (pdf["row"].to_numpy() == want["row"].to_numpy()).all()
    t = ranges.running_totals(df, ["score", "row"], {"sum": "x"}).toPandas().sort_values(["score", "row"])
    assert (t["sum"].to_numpy() == t["x"].cumsum().to_numpy()).all() and (t["p"] == "payload").all()


def test_no_window_over_all_rows(spark, capsys):
    df = spark.range(1_000).selectExpr("id AS row", "double(id % 7) AS score", "int(id % 3 = 0) AS relevant")
    graph.ranked(df, "score", "row").explain()
    ranges.running_totals(df, ["score"], {"s": "relevant"}).explain()
    assert "Window" not in capsys.readouterr().out


def test_running_totals_of_nulls_doubles_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, 3, None), (3, 4, 0.25)], "k int, a int, b double")
    found = ranges.running_totals(df, [F.desc("k")], {"sa": "a", "sb": "b"}).orderBy("k").collect()
    assert [(r.sa, r.sb, r.a) for r in found] == [(7, 0.75, None), (7, 0.25, 3), (4, 0.25, 4)]
    assert ranges.running_totals(df.limit(0), ["k"], {"sa": "a"}).count() == 0 and ranges.numbered(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        ranges.numbered(df.withColumnRenamed("a", ranges.PART), ["k"])


def clustered(rnd, n, dim, groups):
    centres = rnd.normal(0, 4, (groups, dim))
    v = centres[rnd.integers(0, groups, n)] + rnd.normal(0, 0.3, (n, dim))
    v[: n // 3] = v[0]  # a third of all are equal
    return np.round(v, 3)


@pytest.mark.parametrize("metric,exclude", [("ip", False), ("l2", True), ("l2", False)])
def test_bounded_search_equals_brute_force(spark, metric, exclude):
    rnd = np.random.default_rng(3)
    x = clustered(rnd, 1_500, 6, 30)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = range(0, 1_500, 10)
    hits, counts = vectors.bounded_search(df.filter("id % 10 = 0"), df, 7, metric, exclude, rows=32, n_pivots=8)
    scores = x[asked] @ x.T if metric == "ip" else -((x[list(asked)][:, None] - x[None]) ** 2).sum(2)
    for i, q in enumerate(asked):
        scores[i, q] = -np.inf if exclude else scores[i, q]
    scores = np.round(scores, 6)
    want = {(q, j, r + 1) for i, q in enumerate(asked) for r, j in enumerate(sorted(range(1_500), key=lambda j: (-scores[i, j], j))[:7])}
    assert {(r.query, r.item, r["rank"]) for r in hits.collect()} == want
    assert counts["pairs"] == 150 * 1_500 and counts["visited"] < counts["pairs"] * 0.75


def test_search_of_more_than_a_shard_goes_by_bounds(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(clustered(rnd, 400, 4, 9))], "id long, vec array<double>")
    some = df.filter("id % 50 = 0").union(spark.createDataFrame([(999, None)], df.schema))
    whole = [tuple(r) for r in vectors.search(some, df, 5, "id", "id").orderBy("query", "rank").collect()]
    monkeypatch.setattr(vectors, "SHARD_ROWS", 10)
    assert [tuple(r) for r in vectors.search(some, df, 5, "id", "id").orderBy("query", "rank").collect()] == whole and len(whole) == 40
    assert vectors.search(some.limit(0), df, 5, "id", "id").count() == 0


def by_force(rows, k):
    names = sorted({t for _, t, _ in rows})
    ids = sorted({r for r, _, _ in rows})
    m = np.zeros((len(ids), len(names)))
    for r, t, w in rows:
        m[ids.index(r), names.index(t)] += w
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = np.round(np.round(m, 12) @ np.round(m, 12).T, 6)
    return {(ids[i], ids[j], s[i, j]) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] > 0 and m[i].any()}


@pytest.mark.parametrize("block", [8, 64])
def test_cosine_lists_equal_brute_force_and_skip(spark, block):
    rnd = np.random.default_rng(block)
    rows = []
    for i in range(500):
        kind = 3 if i % 3 == 0 else int(rnd.integers(0, 40))  # a third of all rows are of one kind, many of them equal
        own = np.random.default_rng(kind)
        rows += [(i, f"t{kind}-{t}", float(w)) for t, w in zip(range(4), own.random(4) + 0.1, strict=True)]
        rows += [(i, f"common{kind % 2}", 1.0)]
        if i % 3:
            rows.append((i, f"t{int(rnd.integers(0, 300))}", 0.4))
    rows.append((500, "t3-0", 0.0))  # a row of weight 0 has no neighbours
    feats = spark.createDataFrame(rows, "row long, token string, weight double")
    lists, counts = sparse.cosine_lists(feats, 6, block)
    assert {(r.row, r.other, r.w) for r in lists.collect()} == by_force(rows, 6)
    assert counts["rows"] == 500 and counts["visited"] < counts["pairs"] * (0.6 if block == 8 else 1.1)
    empty, _ = sparse.cosine_lists(feats.limit(0), 6)
    assert empty.count() == 0


def test_stored_tables_are_removed(spark):
    from pathlib import Path

    from chimerant.operators import storage

    folder = Path(storage.shared_folder(spark).removeprefix("file://"))
    a, b = storage.stored(spark.range(10), "kept-aside"), storage.bucketed(spark.range(10), "kept-aside", "id")
    made = [p for p in folder.iterdir() if p.name.startswith(("kept-aside", "kept_aside"))]
    assert len(made) == 2 and a.count() == b.count() == 10
    storage.removed(a)
    assert sum(p.exists() for p in made) == 1
    assert storage.clear(spark) >= 1 and not any(p.exists() for p in made) and not any(t.name.startswith("kept_aside") for t in spark.catalog.listTables())


def test_a_step_moves_no_edges(spark, capsys):
    """Edges lie where they were put: the only exchange is of partial sums."""
    from chimerant.operators import storage

    edges = storage.bucketed(spark.range(2_000).selectExpr("id % 97 AS src", "id % 89 AS dst", "0.5D AS w"), "edges", "dst")
    scores = storage.bucketed(spark.range(97).selectExpr("id AS node", "1D AS y", "1D AS s"), "scores", "node")
    step = graph.bucketed_step(edges, scores, 0.5)
    step.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(src") == 1 and "partial_sum" in plan.split("Exchange")[1].split("\n")[1]
    want = graph.step(edges, scores.select("node", "y", "s"), 0.5).collect()
    assert sorted((r.node, round(r.s, 9)) for r in step.collect()) == sorted((r.node, round(r.s, 9)) for r in want)
    local = {r.node: r.s for r in graph._diffuse_local(edges, scores.select("node", "y"), 0.5, 7, 0.0).collect()}
    far = {r.node: r.s for r in graph.diffuse_bucketed(edges, scores.select("node", "y"), 0.5, 7, 0.0).collect()}
    assert local.keys() == far.keys() and all(abs(local[n] - far[n]) < 1e-9 for n in local)


def test_fasta_marks_inside_headers_and_gzip(spark, tmp_path):
    text = "\n>P1.1 pep transcript:T1.2 description:binding A->B factor\nMK\nLV*\r\n>P2 gene > other transcript:T2\r\nAC\r\n>P3\n>P4 x\nGG"
    (tmp_path / "a.fa").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(text.replace("P", "Z").encode())
    want = [("P1.1 pep transcript:T1.2 description:binding A->B factor", "MKLV*"), ("P2 gene > other transcript:T2", "AC"), ("P3", ""), ("P4 x", "GG")]
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == want
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "b.fa.gz")).collect())) == [(h.replace("P", "Z"), s) for h, s in want]
    found = lookups.fasta_lookups(tables.read_fasta(spark, str(tmp_path / "a.fa")))["peptide_lookup"]
    assert {tuple(r) for r in found.collect()} == {("T1", "MKLV*", "P1"), ("T2", "AC", "P2")}
