"""Streams: files as they arrive, running category counts, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int = 20, **options) -> DataFrame:
    """New files of a folder, at most `files` in a batch; the schema is given, not inferred."""
    return spark.readStream.schema(schema).format(fmt).options(maxFilesPerTrigger=files, **options).load(folder)


def document_stream(spark: SparkSession, folder: str, suffix: str = "pdf", files: int = 20) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("maxFilesPerTrigger", files).load(folder)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Counts per category, for output mode complete."""
    return stream.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per category and event-time window; later rows than the watermark are dropped, windows are emitted once."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), column).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result table."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _table_path(folder: str, batch: int) -> str:
    return f"{folder}/batch-{batch:012d}"


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """The batches' tables that are whole, in order."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-*/_SUCCESS")
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getParent().toString() for s in store.globStatus(found) or [])


def append_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A stream's batches as tables of their own numbers: a batch that runs again after a restart replaces itself, so no row comes twice."""
    return stream.writeStream.outputMode(mode).foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(_table_path(folder, i))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, folder: str, schema) -> DataFrame:
    paths = _complete(spark, folder)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_latest(stream: DataFrame, folder: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """The latest row of each key, as a table that every batch replaces.

    A batch's table is the one before it merged with the batch's rows, so it depends on nothing that a rerun could change: the
    batch that was cut off is merged again, with the same table before it, and takes its own place. Later `order` wins, then the
    larger row. Tables before the last two are removed."""
    columns = stream.columns
    rank = F.struct(*order, *[c for c in columns if c not in order])

    def merge(rows: DataFrame, i: int) -> None:
        spark = rows.sparkSession
        before = [p for p in _complete(spark, folder) if int(p.rsplit("-", 1)[1]) < i]
        every = rows.select(*columns).unionByName(spark.read.schema(rows.schema).parquet(before[-1])) if before else rows.select(*columns)
        every.groupBy(*key).agg(F.max(rank).alias("_row")).select("_row.*").select(*columns).write.mode("overwrite").parquet(_table_path(folder, i))
        for old in before[:-1]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, schema) -> DataFrame:
    paths = _complete(spark, folder)
    return spark.read.schema(schema).parquet(paths[-1]) if paths else spark.createDataFrame([], schema)


def _sessions_of(gap_ms: int):
    """State of a key: the sessions that are still open, as (start, end, rows); end is the last row's time plus the gap."""

    def run(key, batches, state):
        import numpy as np
        import pandas as pd

        open_ = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            for at in batch["_at"].tolist():
                open_.append((at, at + gap_ms, 1))
        merged: list[tuple[int, int, int]] = []
        for start, end, n in sorted(open_):
            if merged and start < merged[-1][1]:
                s, e, m = merged[-1]
                merged[-1] = (s, max(e, end), m + n)
            else:
                merged.append((start, end, n))
        mark = state.getCurrentWatermarkMs()
        done, open_ = [s for s in merged if s[1] <= mark], [s for s in merged if s[1] > mark]
        if open_:
            state.update(tuple(list(c) for c in zip(*open_, strict=True)))
            state.setTimeoutTimestamp(max(min(e for _, e, _ in open_), mark + 1))
        elif state.exists:
            state.remove()
        if done:
            times = np.array(done, np.int64)  # as arrays: a time object for each cell costs more than the rest of a key's work
            yield pd.DataFrame({"key": [key[0]] * len(done), "start": times[:, 0].astype("datetime64[ms]"), "end": times[:, 1].astype("datetime64[ms]"), "n": times[:, 2]})

    return run


def state_sessions(stream: DataFrame, time: str, key: str, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions that are over, each once, as state that the stream keeps for each key.

    Times are taken in whole milliseconds. A row within the gap after a session's last row, or before its first, belongs to it,
    and may join two. A session is over when the watermark has reached its end; rows later than the watermark are dropped
    where they would have to open it again. For output mode append."""
    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time), F.unix_millis(time).alias("_at"))
    return rows.groupBy("key").applyInPandasWithState(_sessions_of(gap_minutes * 60_000), f"key {kind}, start timestamp, end timestamp, n long", "starts array<long>, ends array<long>, counts array<long>", "append", "EventTimeTimeout")
