"""Batches under a budget, as a column of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Packer:
    """The state of a stream: which group it is in, and the number, rows and load of the open batch."""

    def __init__(self, most: int, budget: int):
        self.most, self.budget, self.group = most, budget, None
        self.batch = self.rows = self.load = 0

    def put(self, group: tuple, length: int) -> int:
        if group != self.group:
            self.group, self.batch, self.rows, self.load = group, 0, 0, 0
        elif self.rows >= self.most or self.load + length > self.budget:
            self.batch, self.rows, self.load = self.batch + 1, 0, 0
        self.rows, self.load = self.rows + 1, self.load + length
        return self.batch


def packed(df: DataFrame, by: list[str], length: str, most: int, budget: int, key: str, out: str = "batch") -> DataFrame:
    """df with the number (from 0) of each row's batch in its group: at most `most` rows and `budget` of length, longest first.

    Rows are shuffled by group, sorted, and pass as a stream through a state of a few numbers, so a group of any size takes no
    memory; a row over the budget is a batch of its own; a null length is 0. `key` orders rows of equal length."""
    if out in df.columns:
        raise ValueError(f"{out} exists")
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    sorted_ = df.withColumn("_length", size).repartition(*by).sortWithinPartitions(*by, F.desc("_length"), key)
    places = [sorted_.columns.index(c) for c in by]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Packer(most, budget)
        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in places), strict=True)
            numbers = np.fromiter(map(state.put, groups, batch.column(batch.num_columns - 1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers)], schema.names)

    return sorted_.mapInArrow(run, schema)
