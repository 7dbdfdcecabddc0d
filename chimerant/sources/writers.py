"""Writers: tables, FASTA, JSON, vectors; names of stage outputs."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import STAGE_TAGS
from chimerant.functions.text import present
from chimerant.operators.ranges import numbered

FRAGMENTS = ["retained_peptide1", "lost_peptide1", "retained_peptide2", "lost_peptide2"]


def tsv_path(path: str) -> str:
    """The path with the suffix .tsv, whatever it had."""
    return re.sub(r"\.[^./]*$", "", path) + ".tsv"


def save_table(df: DataFrame, path: str, single: bool = True, mode: str = "overwrite") -> str:
    """A tab-separated table with a header. single: one part file, for results that people read."""
    (df.coalesce(1) if single else df).write.option("sep", "\t").option("header", True).mode(mode).csv(out := tsv_path(path))
    return out


def save_new(df: DataFrame, path: str) -> None:
    """Parquet, refusing to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def fragments(df: DataFrame, columns: list[str] = FRAGMENTS) -> DataFrame:
    """(id, col, sequence) of the fragments that are present."""
    parts = ", ".join(f"'{c}', `{c}`" for c in columns)
    return df.selectExpr("id", f"stack({len(columns)}, {parts}) AS (col, sequence)").filter(present(F.col("sequence")))


def fasta_records(df: DataFrame, columns: list[str] = FRAGMENTS, long_header: bool = True) -> DataFrame:
    """One FASTA record per fragment: `id|side=col|len=n`, or `id|col`."""
    f = fragments(df, columns)
    header = F.format_string(">%s|side=%s|len=%d", F.col("id").cast("string"), "col", F.length("sequence")) if long_header else F.format_string(">%s|%s", F.col("id").cast("string"), "col")
    return f.select("id", "col", F.concat(header, F.lit("\n"), "sequence").alias("value"))


def save_fasta(records: DataFrame, path: str) -> None:
    records.select("value").write.mode("overwrite").text(path)


def wrapped(c, width: int = 60):
    """A sequence in lines of a width."""
    return F.regexp_replace(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def chunked(df: DataFrame, order: list[str], chunks: int, out: str = "chunk") -> DataFrame:
    """Chunk numbers 0..chunks-1 of ceil(N / chunks) rows each, in order."""
    rows = numbered(df, order, "_rn")
    per = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / chunks))
    return rows.withColumn(out, F.least(F.floor((F.col("_rn") - 1) / per), F.lit(chunks - 1)).cast("int")).drop("_rn")


def save_chunks(records: DataFrame, order: list[str], chunks: int, path: str) -> None:
    """Records (value) in chunk folders `chunk=i`, written in one pass over the records."""
    chunked(records, order, chunks).select("value", "chunk").repartition("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").mode("errorifexists").text(path)


def save_outputs(tagged: DataFrame, tag: str, folder: str, prefix: str = "") -> list[str]:
    """Rows of several outputs, told apart by a column, written in one pass: each output becomes the Parquet folder `prefix` + its name.

    Refuses to overwrite: the outputs are written aside and renamed only if none is there yet."""
    spark = tagged.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    aside = f"{folder}/_outputs-{uuid.uuid4().hex}"
    store = path(aside).getFileSystem(conf)
    tagged.write.partitionBy(tag).parquet(aside)
    try:
        found = {s.getPath().getName().removeprefix(f"{tag}="): s.getPath() for s in store.listStatus(path(aside)) if s.getPath().getName().startswith(f"{tag}=")}
        targets = {n: f"{folder}/{prefix}{n}" for n in sorted(found)}
        if there := [t for t in targets.values() if store.exists(path(t))]:
            raise FileExistsError(f"exists: {', '.join(there)}")
        for n, t in targets.items():
            store.rename(found[n], path(t))
        return list(targets.values())
    finally:
        store.delete(path(aside), True)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def plain_name(name: str) -> str:
    """The name, if it is a plain file name."""
    if Path(name).name != name or not name:
        raise ValueError(f"{name} is no plain file name")
    return name


def stem_of(name: str) -> str:
    base = re.sub(r"\.(csv|tsv|fa|fasta)\.gz$", "", Path(name).name)
    return re.sub(r"[^\w.-]+", "_", Path(base).stem)


def stage_path(folder: str, name: str, tag: str, suffix: str) -> str:
    """A stage's output path: the input's stem without the tags of earlier stages at its end, then the tag."""
    tags = "|".join(map(re.escape, sorted(STAGE_TAGS, key=len, reverse=True)))
    bare = re.sub(rf"(?:(?:^|_)(?:{tags}))+$", "", stem_of(name))
    return f"{folder}/{bare}_{tag}.{suffix.removeprefix('.')}"


def clear_files(folder: str, spark=None) -> int:
    """Delete the files below a folder and keep its folders; with a session the folder may be in any store that it reads."""
    if spark is None:
        files = [p for p in Path(folder).rglob("*") if p.is_file()]
        for p in files:
            p.unlink()
        return len(files)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store, n = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    found = store.listFiles(root, True) if store.exists(root) else None
    while found is not None and found.hasNext():
        n += store.delete(found.next().getPath(), False)
    return n
