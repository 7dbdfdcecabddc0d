"""Tables of a run in the shared folder: a stage's plan ends there, and a lost executor costs nothing before it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder where it is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/chimerant-{spark.sparkContext.applicationId}"


#: Paths of the tables that this driver has made and not yet removed.
_MADE: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read again: what follows plans over the table, not over df's own plan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as a table bucketed and sorted by a column, one file a bucket, in the shared folder: joins and groups by that column move none of it.

    As many buckets as spark.sql.shuffle.partitions, so what is shuffled by the column meets the buckets where they are."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    _MADE.append(path)
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return spark.table(table)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if spark.catalog.tableExists(name := folder.rsplit("/", 1)[1].replace("-", "_")):
        spark.sql(f"DROP TABLE `{name}`")


def removed(df: DataFrame) -> None:
    """Delete the files of a table made here, when nothing will read it again; of a bucketed one the name goes too."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        _MADE[:] = [m for m in _MADE if m.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def clear(spark: SparkSession) -> int:
    """Delete all tables that this driver has made and not removed; tells how many. Nothing that reads them may be used after it."""
    made = list(_MADE)
    for folder in made:
        _delete(spark, folder)
    _MADE.clear()
    return len(made)
