"""An external annotator over any number of sequences, in batches that are run again alone where they failed.

Queries are numbered in order and cut into batches of a stated size, so a batch holds the same queries in every run. Waves
of batches are jobs of their own; what a wave has done is a table in the ledger's folder, and counts only when whole. A
batch that fails is noted, the others of its wave stay done, and it alone is tried again. A run that was ended goes on where its
ledger stops.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.operators.ranges import numbered

#: Takes (query, sequence) and returns (query, accession, name).
Annotate = Callable[[pd.DataFrame], pd.DataFrame]
SIZE, WAVE, TRIES = 5_000, 64, 2
#: Each wave is a job that reads the ledger, so a run of very many batches has larger waves, not more of them.
WAVES = 8
_ROWS = "batch long, query string, accession string, name string, place int, error string"


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered_queries(queries: DataFrame, folder: str, size: int) -> DataFrame:
    """(batch, query, sequence), written once for all runs."""
    if not _exists(queries, f"{folder}/queries/_SUCCESS"):
        rows = numbered(queries.select("query", "sequence"), ["query"], "n").select(F.floor((F.col("n") - 1) / size).alias("batch"), "query", "sequence")
        rows.write.mode("overwrite").parquet(f"{folder}/queries")
    return queries.sparkSession.read.parquet(f"{folder}/queries")


def ledger(queries: DataFrame, folder: str) -> DataFrame | None:
    """The rows of all waves that are whole; a batch that is done has a row without query and without error."""
    spark = queries.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/wave-*/_SUCCESS")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    waves = [s.getPath().getParent().toString() for s in found or []]
    return spark.read.schema(_ROWS).parquet(*waves) if waves else None


def _run(annotate: Annotate):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(key[0])
        columns = ["query", "accession", "name"]
        try:
            hits = annotate(rows[["query", "sequence"]].sort_values("query", ignore_index=True))[columns]
            cells, error = [hits[c].tolist() for c in columns], None
        except Exception as e:  # noqa: BLE001 - a failed batch is noted and tried again, whatever it was
            cells, error = [[]] * 3, f"{type(e).__name__}: {e}"[:1000]
        n = len(cells[0])
        return pd.DataFrame({"batch": [batch] * (n + 1), **{c: [None, *x] for c, x in zip(columns, cells, strict=True)}, "place": range(-1, n), "error": [error] * (n + 1)})

    return run


def annotate_in_batches(queries: DataFrame, annotate: Annotate, folder: str, size: int = SIZE, wave: int = WAVE, tries: int = TRIES) -> DataFrame:
    """(query, accession, name, place) of all hits; place is that of a hit in its batch's output. queries: (query, sequence).

    Each call works on the batches that the ledger lacks. Batches that failed `tries` times in this call end it with an error,
    and stay open for the next call."""
    rows = numbered_queries(queries, folder, size)
    wave = max(wave, -(-((rows.agg(F.max("batch")).first()[0] or 0) + 1) // WAVES))
    failed: dict[int, tuple[int, str]] = {}
    while True:
        known = ledger(queries, folder)
        open_ = rows.select("batch").distinct()
        if known is not None:
            open_ = open_.join(known.filter("query IS NULL AND error IS NULL").select("batch"), "batch", "left_anti")
        spent = [b for b, (n, _) in failed.items() if n >= tries]  # batches that have failed here, not data
        todo = (open_.filter(~F.col("batch").isin(spent)) if spent else open_).orderBy("batch").limit(wave)
        n, low, high = todo.agg(F.count(F.lit(1)), F.min("batch"), F.max("batch")).first()
        if not n:
            break
        own = rows.filter(F.col("batch").between(low, high))  # a wave's batches lie together in the table, which is in order
        number = 0
        while _exists(queries, f"{folder}/wave-{number:06d}"):
            number += 1
        path = f"{folder}/wave-{number:06d}"
        (own if n == high - low + 1 else own.join(F.broadcast(todo), "batch", "left_semi")).groupBy("batch").applyInPandas(_run(annotate), _ROWS).write.parquet(path)
        for r in queries.sparkSession.read.parquet(path).filter("error IS NOT NULL").select("batch", "error").collect():  # a wave's batches at most
            failed[r.batch] = (failed.get(r.batch, (0, ""))[0] + 1, r.error)
    if spent := {b: e for b, (n, e) in failed.items() if n >= tries}:
        raise RuntimeError("batches failed: " + "; ".join(f"{b} ({e})" for b, e in sorted(spent.items())))
    done = ledger(queries, folder)
    if done is None:
        return queries.sparkSession.createDataFrame([], "query string, accession string, name string, place int")
    return done.filter("query IS NOT NULL").select("query", "accession", "name", "place")


def command(arguments: Callable[[str, str], list[str]]) -> Annotate:
    """An annotator that runs a program on a FASTA file of the batch: arguments(fasta, out) gives its command line."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import subprocess
        import tempfile
        from pathlib import Path

        with tempfile.TemporaryDirectory() as d:  # a task's own scratch, read again by the same task only
            fasta, out = Path(d) / "in.fa", Path(d) / "out.tsv"
            fasta.write_text("".join(f">{q}\n{s}\n" for q, s in zip(rows["query"], rows["sequence"], strict=True)))
            subprocess.run(arguments(str(fasta), str(out)), check=True)
            cells = [line.rstrip("\n").split("\t") for line in out.open() if not line.startswith("#")]
        hits = [(c[0].strip(), c[11].strip(), c[12].strip()) for c in cells if len(c) > 12]
        return pd.DataFrame([h for h in hits if h[0] and h[1]], columns=["query", "accession", "name"])

    return run
