"""Matrix files in stores that aren't mounted, batches under a budget, seeded orders, annotator batches, outputs of one pass."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chimerant.operators import packing, shuffling
from chimerant.plans import batches, lookups, retrieval
from chimerant.sources import matrix, writers




def vectors(spark, rows, dim=6, seed=1):
    m = np.random.default_rng(seed).random((rows, dim), np.float32)
    return m, spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(m)], "pos long, vec array<float>").repartition(5)


@pytest.mark.parametrize("kind,metric", [("npy", None), ("ip", "ip"), ("l2", "l2")])
def test_round_trip_where_spark_cannot_look(spark, tmp_path, kind, metric):
    root, opener = f"vault:/{tmp_path}", "tests.opener:vault"
    path, there = f"{root}/x/index", tmp_path / "x/index"
    m, df = vectors(spark, 1_000)
    matrix.save_vectors(df, path, kind, opener, rows_per_part=150)
    assert not os.path.exists(path)
    names = sorted(p.name for p in there.iterdir())
    assert len(names) > 4 and names[0] == "_SUCCESS" and not any("temporary" in n for n in names)
    got = matrix.read_vectors(spark, path, 70, opener)
    assert got.rdd.getNumPartitions() > 10
    rows = got.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1_000)) and np.array_equal(np.array([r.vec for r in rows], np.float32), m)
    assert matrix.index_metric(spark, path, opener) == metric
    with pytest.raises(Exception, match="x/index"):
        matrix.save_vectors(df, path, kind, opener)
    assert sorted(p.name for p in there.iterdir()) == names
    matrix.save_vectors(df.limit(10), path, kind, opener, mode="overwrite")
    assert matrix.read_vectors(spark, path, filesystem=opener).count() == 10


def test_a_store_that_only_spark_opens(spark, tmp_path):
    m, df = vectors(spark, 500)
    matrix.save_vectors(df, f"file://{tmp_path}/parts/index", "l2", rows_per_part=100)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./in", f"file://{tmp_path}/parts")
    rows = matrix.read_vectors(spark, "viewfs://only/in/index").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(500)) and np.array_equal(np.array([r.vec for r in rows], np.float32), m)
    assert matrix.index_metric(spark, "viewfs://only/in/index") == "l2"


def test_failed_writes_leave_nothing_behind(spark, tmp_path):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "pos long, vec array<float>")
    with pytest.raises(Exception, match="different widths"):
        matrix.save_vectors(bad, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no nulls"):
        matrix.save_vectors(spark.createDataFrame([(1, [None, 1.0])], "pos long, vec array<float>"), str(tmp_path / "bad"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    empty = spark.createDataFrame([], "pos long, vec array<float>")
    assert matrix.read_vectors(spark, matrix.save_vectors(empty, str(tmp_path / "none"))).count() == 0
    with pytest.raises(FileNotFoundError):
        matrix.read_vectors(spark, str(tmp_path / "absent"))


def test_batches_under_a_budget(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3 > 0), int(n) if n else None, f"x{i}") for i, n in enumerate(rng.integers(0, 900, 3_000))]
    df = spark.createDataFrame(rows, "id long, g int, n long, x string").repartition(6)
    got = packing.packed(df, ["g"], "n", 16, 2_000, "id").toPandas()
    assert len(got) == 3_000 and set(got.columns) == {"id", "g", "n", "x", "batch"}
    for g, own in got.groupby("g"):
        lengths = sorted(((-(r[2] or 0), r[0]) for r in rows if r[1] == g))
        packs = retrieval.pack([-n for n, _ in lengths], 16, 2_000)
        want = {lengths[i][1]: b for b, part in enumerate(packs) for i in part}
        assert dict(zip(own["id"], own["batch"], strict=True)) == want
    assert packing.packed(df.limit(0), ["g"], "n", 16, 2_000, "id").count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, ["g"], "n", 16, 2_000, "id", "x")


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 5_000])
def test_places_are_different_and_seeds_differ(spark, n):
    rows = spark.range(n).select("id", shuffling.place(F.col("id"), n, 1).alias("a"), shuffling.place(F.col("id"), n, 2).alias("b")).toPandas()
    size = 4 ** shuffling.half_bits(n)
    assert rows["a"].nunique() == n and rows["a"].between(0, size - 1).all() and size < max(16, 8 * n)
    if n == 5_000:
        turn = rows["a"].rank().to_numpy()
        assert abs(np.corrcoef(rows["id"], turn)[0, 1]) < 0.05 and (rows["a"] != rows["b"]).mean() > 0.9


def test_seeded_split_is_exact_and_the_same_again(spark):
    df = spark.range(1_003).select((F.col("id") * 2).alias("k"), F.lit("p").alias("payload"))
    a, b = (shuffling.split(df.repartition(p), ["k"], 0.2, 34).toPandas().sort_values("k") for p in (3, 7))
    assert (a["part"].to_numpy() == b["part"].to_numpy()).all() and (a["part"] == "holdout").sum() == 1_003 - int(1_003 * 0.8)
    assert a["part"].iloc[:500].eq("holdout").mean() == pytest.approx(0.2, abs=0.06)


def failing(folder, bad):
    """An annotator that notes its calls, and fails the first time for batches that hold one of `bad`."""

    def run(rows):
        from pathlib import Path

        name = "-".join(sorted(rows["query"])[:1])
        tried = Path(folder) / name
        before = len(list(Path(folder).glob(f"{name}.*")))
        (Path(folder) / f"{tried.name}.{before}").touch()
        if set(rows["query"]) & set(bad) and before < 1:
            raise OSError("no such program")
        return pd.DataFrame({"query": rows["query"], "accession": "A" + rows["sequence"], "name": "n"})

    return run


def test_a_failed_batch_is_retried_alone(spark, tmp_path):
    queries = spark.createDataFrame([(f"q{i:03}", f"S{i}") for i in range(57)], "query string, sequence string")
    calls = tmp_path / "calls"
    calls.mkdir()
    found = batches.annotate_in_batches(queries, failing(str(calls), ["q012"]), str(tmp_path / "ledger"), 10, wave=4)
    assert sorted((r.query, r.accession) for r in found.collect()) == [(f"q{i:03}", f"AS{i}") for i in range(57)]
    assert sorted(p.name for p in calls.iterdir()) == ["q000.0", "q010.0", "q010.1", "q020.0", "q030.0", "q040.0", "q050.0"]
    again = batches.annotate_in_batches(queries, failing(str(calls), []), str(tmp_path / "ledger"), 10)
    assert again.count() == 57 and len(list(calls.iterdir())) == 7  # nothing is run again


def test_a_run_that_ended_goes_on(spark, tmp_path):
    queries = spark.createDataFrame([(f"q{i:03}", f"S{i}") for i in range(30)], "query string, sequence string")
    calls = tmp_path / "calls"
    calls.mkdir()
    with pytest.raises(RuntimeError, match="1 .OSError: no such program"):
        batches.annotate_in_batches(queries, failing(str(calls), ["q012"]), str(tmp_path / "ledger"), 10, tries=1)
    (tmp_path / "ledger" / "wave-000009").mkdir()  # a wave that was cut off: no mark, so it doesn't count
    assert batches.annotate_in_batches(queries, failing(str(calls), ["q012"]), str(tmp_path / "ledger"), 10).count() == 30
    assert sorted(p.name for p in calls.iterdir()) == ["q000.0", "q010.0", "q010.1", "q020.0"]


def test_a_program_runs_on_each_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "MKV", ".", None, "MKV"), (2, "AAA", "CC", ".", ".")], "id long, retained_peptide1 string, lost_peptide1 string, retained_peptide2 string, lost_peptide2 string")
    script = "BEGIN{OFS=\"\\t\"} /^>/{q=substr($0,2);next} {print q,\"m\",length($0),\"a\",\"b\",\"c\",1,2,3,\"T\",\"d\",\"IPR\" length($0),\"name\"}"
    annotator = retrieval.command_annotator(lambda fasta, out: ["sh", "-c", f"awk '{script}' {fasta} > {out}"], str(tmp_path / "ledger"), 2)
    rows = {r.id: r for r in retrieval.by_annotator(events, annotator).collect()}
    assert rows[1].retained_domains1 == "IPR3" and rows[1].lost_domains1 == "." and rows[2].lost_domains1 == "IPR2" and rows[2].retained_domain_names1 == "name"




def test_outputs_of_one_pass(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text("\n".join(f">P{i}.1 x{' transcript:T' + str(i) if i % 2 else ''}\nMK{'A' * i}\nV" for i in range(9)))
    from chimerant.sources import tables

    tagged = lookups.fasta_outputs(tables.read_fasta(spark, str(tmp_path / "a.fa")))
    tagged.explain()
    assert capsys.readouterr().out.count("FileScan text") == 1
    made = writers.save_outputs(tagged, "output", str(tmp_path / "out"), "my_")
    assert [m.rsplit("/", 1)[1] for m in made] == ["my_clean_fasta", "my_peptide_lookup", "my_protein_lookup"]
    assert spark.read.parquet(made[1]).count() == 4 and spark.read.parquet(made[2]).count() == 9
    assert spark.read.parquet(made[0]).filter("value = '>P2\nMKAAV'").count() == 1
    with pytest.raises(FileExistsError):
        writers.save_outputs(tagged, "output", str(tmp_path / "out"), "my_")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["my_clean_fasta", "my_peptide_lookup", "my_protein_lookup"]
    records = spark.range(20).select("id", F.format_string(">r%02d", "id").alias("value"))
    writers.save_chunks(records, ["id"], 3, str(tmp_path / "chunks"))
    assert [(tmp_path / "chunks" / f"chunk={i}").exists() for i in range(4)] == [True, True, True, False]
    assert [spark.read.text(str(tmp_path / "chunks" / f"chunk={i}")).count() for i in range(3)] == [7, 7, 6]
