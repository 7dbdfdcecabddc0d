"""Streams that are cut off and go on, late rows, sessions as state; page rasters against whole images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.plans import expression, raster
from chimerant.streaming import intake

SCHEMA = "k string, t timestamp, v long"


def put(spark, folder, i, rows):
    spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/p{i}")


def stream(spark, folder):
    return intake.table_stream(spark, f"{folder}/in/*", SCHEMA, files=1)


def cut_off(monkeypatch, at):
    """The driver dies after the rows of batch `at` are written and before the stream has noted it."""
    real = intake._table_path
    state = {"cut": False}

    def path(folder, batch):
        if batch == at and not state["cut"]:
            state["cut"] = True
            raise RuntimeError("the driver died")
        return real(folder, batch)

    monkeypatch.setattr(intake, "_table_path", path)
    return state


def test_a_restart_in_mid_stream_gives_no_row_twice(spark, tmp_path, monkeypatch):
    rows = [(f"k{i % 5}", f"2024-01-01 00:{i:02}:00", i) for i in range(40)]
    for i in range(4):
        put(spark, tmp_path, i, rows[i * 10 : i * 10 + 10])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    fail = {"left": 1}

    def dying(batch, i):  # writes the batch, then ends before the stream commits it
        batch.write.mode("overwrite").parquet(intake._table_path(out, i))
        if i == 2 and fail["left"]:
            fail["left"] = 0
            raise RuntimeError("the driver died")

    first = stream(spark, tmp_path).writeStream.foreachBatch(dying).option("checkpointLocation", cp).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="driver died"):
        first.awaitTermination()
    assert intake.appended(spark, out, SCHEMA).count() == 30
    intake.append_once(stream(spark, tmp_path), out, cp).awaitTermination()
    assert sorted(r.v for r in intake.appended(spark, out, SCHEMA).collect()) == list(range(40))
    put(spark, tmp_path, 4, [("k9", "2024-01-02 00:00:00", 99)])
    intake.append_once(stream(spark, tmp_path), out, cp).awaitTermination()
    assert intake.appended(spark, out, SCHEMA).count() == 41


def test_latest_rows_survive_a_restart(spark, tmp_path, monkeypatch):
    for i in range(4):
        put(spark, tmp_path, i, [(f"k{j % (i + 2)}", f"2024-01-01 0{i}:{j:02}:00", 10 * i + j) for j in range(8)])
    put(spark, tmp_path, 4, [("k0", "2023-01-01 00:00:00", -1), ("k8", "2024-01-01 00:00:00", 7), ("k8", "2024-01-01 00:00:00", 8)])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    cut_off(monkeypatch, 2)
    with pytest.raises(Exception, match="driver died"):
        intake.keep_latest(stream(spark, tmp_path), out, ["k"], ["t"], cp).awaitTermination()
    intake.keep_latest(stream(spark, tmp_path), out, ["k"], ["t"], cp).awaitTermination()
    every = spark.read.parquet(*(str(tmp_path / "in" / f"p{i}") for i in range(5)))
    want = {r.k: (r.t, r.v) for r in every.groupBy("k").agg(F.max(F.struct("t", "v")).alias("m")).select("k", "m.*").collect()}
    assert {r.k: (r.t, r.v) for r in intake.latest(spark, out, SCHEMA).collect()} == want
    assert len(list((tmp_path / "out").glob("batch-*"))) == 2
    assert intake.latest(spark, str(tmp_path / "none"), SCHEMA).count() == intake.appended(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_sessions_late_rows_and_a_restart(spark, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        found = intake.state_sessions(stream(spark, tmp_path), "t", "k").select("key", F.date_format("start", "HH:mm").alias("start"), F.date_format("end", "HH:mm").alias("end"), "n")
        intake.append_once(found, out, cp).awaitTermination()
        return sorted(tuple(r) for r in intake.appended(spark, out, found.schema).collect())

    put(spark, tmp_path, 0, [("a", "2024-01-01 00:00", 1), ("a", "2024-01-01 00:50", 1), ("b", "2024-01-01 00:05", 1)])
    put(spark, tmp_path, 1, [("a", "2024-01-01 00:25", 1), ("b", "2024-01-01 01:00", 1)])  # joins two sessions of a
    assert run() == [("b", "00:05", "00:35", 1)]  # the mark is 00:50
    put(spark, tmp_path, 2, [("b", "2024-01-01 00:10", 9), ("b", "2024-01-01 01:10", 1), ("c", "2024-01-01 03:00", 1)])  # 00:10 is later than the mark: dropped
    assert run() == [("a", "00:00", "01:20", 3), ("b", "00:05", "00:35", 1), ("b", "01:00", "01:40", 2)]
    assert run() == [("a", "00:00", "01:20", 3), ("b", "00:05", "00:35", 1), ("b", "01:00", "01:40", 2)]


def test_closed_windows_once_and_late_rows_dropped(spark, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        found = intake.windowed_counts(stream(spark, tmp_path), "t", "k").select("k", F.date_format("window.start", "HH:mm").alias("start"), "n")
        intake.append_once(found, out, cp).awaitTermination()
        return sorted(tuple(r) for r in intake.appended(spark, out, found.schema).collect())

    put(spark, tmp_path, 0, [("a", "2024-01-01 00:10", 1), ("a", "2024-01-01 00:50", 1)])
    put(spark, tmp_path, 1, [("a", "2024-01-01 00:20", 1), ("a", "2024-01-01 01:10", 1)])
    assert run() == [("a", "00:00", 3)]
    put(spark, tmp_path, 2, [("a", "2024-01-01 00:30", 1), ("b", "2024-01-01 02:30", 1)])
    assert run() == [("a", "00:00", 3), ("a", "01:00", 1)]


def page(seed, parity):
    rng = np.random.default_rng(seed)
    p = np.full((360, 1700, 3), rng.integers(215, 240), np.uint8)
    start, width = 700 + int(rng.integers(0, 200)), int(rng.integers(1, 120))
    p[:, start : start + width] = 255
    for _ in range(30):
        x, w, h = int(rng.integers(220, 1590)), int(rng.integers(1, 40)), int(rng.integers(1, 84))
        p[334 - h : 334, x : x + w] = rng.integers(120, 225, 3)
    if seed % 3:
        for x in rng.integers(230, 1590, 3):
            p[250:334, x : x + 2] = (255, 10, 0) if parity else (0, 10, 255)
    return p


@pytest.mark.parametrize("parity", [True, False])
def test_rasters_equal_whole_images(spark, parity):
    cfg = Config(parity=parity)
    pages = [page(i, parity) for i in range(8)] + [np.zeros((400, 1700, 3), np.uint8), np.full((400, 900, 3), 255, np.uint8), np.full((280, 1200, 4), 230, np.uint8), np.zeros((100, 50, 3), np.uint8)]
    docs = spark.createDataFrame([("ok", bytearray(b"x")), ("broken", bytearray(b"y"))], "path string, content binary")

    def render(content):
        if bytes(content) == b"y":
            raise ValueError("no document")
        return pages

    found = raster.pixel_columns(raster.rasters(docs, render), cfg)
    want = pd.concat([expression.analyse_page(f"ok#{i}", p, cfg) for i, p in enumerate(pages)])
    key = ["page_id", "side", "half", "x"]
    got = found.toPandas().sort_values(key, ignore_index=True)
    want = want.sort_values(key, ignore_index=True)
    assert len(got) == len(want) > 5_000
    assert (got[[*key, "bottom", "height"]].to_numpy() == want[[*key, "bottom", "height"]].to_numpy()).all()
    assert dict(found.dtypes) == {"page_id": "string", "side": "int", "half": "string", "x": "int", "bottom": "boolean", "height": "int"}
