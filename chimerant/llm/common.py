"""What the corpus operators share: the shared folder, tables that cut lineage, and connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, which separates words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chimerant-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: the lineage ends there, and a lost executor costs nothing before it.

    The shuffle files of the job are let go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by cut(), when nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def blocks_for(df: DataFrame, text: str, chars: int, least: int = 1) -> int:
    """How many blocks of about `chars` bytes of text the table makes: it grows with the data."""
    total = df.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(least, math.ceil(total / chars))


def join_hot(rows: DataFrame, keys: DataFrame, on: str, count: str) -> DataFrame:
    """rows joined with keys, a stored table with one row for each value of `on` and the rows that it has in `count`.

    Keys of over `least` rows, fewer than a million whatever the data, are broadcast, so no task gets all rows of one."""
    least = max(100_000, (keys.agg(F.sum(count)).first()[0] or 0) // 1_000_000)
    hot, others = keys.filter(F.col(count) > least), keys.filter(F.col(count) <= least)
    if hot.isEmpty():
        return rows.join(others, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(others, on))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): returns (node, comp), comp being the smallest node of the component.

    Smallest-label propagation with pointer jumping: every round is two joins and a partial aggregate, so a star with
    any number of leaves never meets in one task. Each round's labels are a table in the shared folder.
    An empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        new = step.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("comp"))
        new = cut(new, f"{name}-labels")
        changed = not new.filter("old <> comp").isEmpty()
        drop_table(labels)
        labels = new.select("node", "comp")
        if not changed:
            drop_table(both)
            return labels
