"""Stage commands one after the other, and vectors from matrix files and flat indexes."""

import struct

import numpy as np
import pytest
from test_engine import ref  # noqa: F401 - the fixture of lookups

from chimerant import cli
from chimerant.sources import matrix, tables


def test_stage_commands(spark, ref, tmp_path):  # noqa: F811
    d, made = ref
    for name, df in made.items():
        if name.endswith("_lookup"):
            df.write.parquet(str(tmp_path / "lookups" / name))
    (tmp_path / "hits.tsv").write_text("\t".join(["1|lost_peptide1", *["x"] * 10, "IPR000001", "Protein kinase domain", "-", "-"]) + "\n")
    cells = ["id", "gene1", "gene2", "retained_domains1", "lost_domains1", "retained_domains2", "lost_domains2"]
    (tmp_path / "positives.tsv").write_text("\n".join("\t".join(r) for r in (cells, ["1", "A", "B", ".", "IPR000001", ".", "."], ["2", "C", "D", "IPR000002", ".", ".", "."])) + "\n")
    more = ["--lookups", str(tmp_path / "lookups"), "--annotations", str(tmp_path / "hits.tsv"), "--positives", str(tmp_path / "positives.tsv"), "--out", str(tmp_path / "out")]
    at = str(d / "events.csv")
    for stage in ("peptides", "domains", "features", "annotated", "scores"):
        assert cli.main(["stage", stage, at, *more]) == 0
        at = str(tmp_path / "out" / f"events_{stage}.tsv")
    rows = {name: {r["id"]: r for r in tables.load_table(spark, str(tmp_path / "out" / f"events_{name}.tsv")).collect()} for name in ("domains", "features", "annotated", "scores")}
    assert all(set(r) == {1, 2, 3} for r in rows.values())
    assert rows["domains"][1]["lost_domains1"] == "IPR000001" and rows["features"][1]["lost_kinases_key_doms1"] == "1"
    assert rows["annotated"][2]["same_gene_fusion"] == "1" and all(0 <= float(r["driver_score"]) <= 1 for r in rows["scores"].values())
    counts = {r["type"]: r["count"] for r in tables.load_table(spark, str(tmp_path / "out" / "events_event_counts.tsv")).collect()}
    assert counts["same_gene_fusion"] == "1" and counts["none"] == "2"


@pytest.mark.parametrize("rows,per_task", [(0, 4), (1, 4), (8, 4), (2_500, 1_100)])
def test_vectors(spark, tmp_path, rows, per_task):
    m = np.random.default_rng(rows).random((rows, 5), np.float32)
    np.save(tmp_path / "m.npy", m)
    for name, metric in ((b"IxFI", 0), (b"IxF2", 1)):
        head = name + struct.pack("<iqqq?iQ", 5, rows, 1 << 20, 1 << 20, True, metric, rows * 5)
        (tmp_path / name.decode()).write_bytes(head + m.tobytes())
    for name, metric in (("m.npy", None), ("IxFI", "ip"), ("IxF2", "l2")):
        got = matrix.read_vectors(spark, str(tmp_path / name), per_task).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(rows)) and np.array_equal(np.array([r.vec for r in got], np.float32).reshape(rows, 5), m)
        assert matrix.index_metric(spark, str(tmp_path / name)) == metric
    (tmp_path / "other").write_bytes(b"IxPQ" + b"\0" * 60)
    np.save(tmp_path / "wide.npy", m.astype(np.float64))
    for bad in ("other", "wide.npy"):
        with pytest.raises(ValueError):
            matrix.read_vectors(spark, str(tmp_path / bad))


def test_loaded_index(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    (tmp_path / "meta.json").write_text('[{"ipr_id": "IPR000001", "name": "a"}, {"IPR": "IPR000002"}, 7]')
    got = {r.pos: (r.ipr_id, r.ipr_name, r.vec) for r in tables.load_index(spark, str(tmp_path / "m.npy"), str(tmp_path / "meta.json")).collect()}
    assert got == {0: ("IPR000001", "a", [1, 0, 0]), 1: ("IPR000002", "", [0, 1, 0]), 2: (".", "", [0, 0, 1])}
