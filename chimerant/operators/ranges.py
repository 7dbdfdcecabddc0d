"""Global order, numbers and running sums without a task that sees all rows.

Rows are dealt by ranges of the order and sorted in each; what a range holds is written once, with the range's number and
each row's place in it, so that counts, sums and the rows themselves come from one and the same dealing. (A range exchange
that is run twice samples its bounds twice, and then counts of the one don't fit the rows of the other.) The driver gets a
row for each range, never the data, and adds up what lies before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.operators.storage import stored

#: Columns of this module's own: the range, the place in it, and the order of equal rows.
PART, AT, TIE = "_range", "_place", "_tie"
_LOCAL = (1 << 33) - 1


def _placed(df: DataFrame) -> DataFrame:
    at = F.monotonically_increasing_id()
    return df.withColumns({PART: F.shiftright(at, 33).cast("int"), AT: at.bitwiseAND(F.lit(_LOCAL))})


def ordered(df: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df dealt by ranges of `order` and sorted, with the range and the place in it (from 0), not stored yet.

    Rows that are equal in the order are dealt to several ranges too, so a value that many rows have is no bottleneck."""
    if clash := {PART, AT, TIE} & set(df.columns):
        raise ValueError(f"reserved columns: {', '.join(sorted(clash))}")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn(TIE, F.monotonically_increasing_id())
    return _placed(marked.repartitionByRange(parts, *order, TIE).sortWithinPartitions(*order, TIE).drop(TIE))


def before(table: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """(range, name, ...): what the ranges before each one add up to. One row for each range, so it can be broadcast."""
    rows = table.groupBy(PART).agg(*(c.alias(n) for n, c in totals.items())).orderBy(PART).collect()
    kinds = {f.name: f.dataType for f in table.groupBy(PART).agg(*(c.alias(n) for n, c in totals.items())).schema}
    zero = {n: 0 if isinstance(kinds[n], T.LongType) else 0.0 for n in totals}
    sums = [list(accumulate((r[n] or zero[n] for r in rows), initial=zero[n])) for n in totals]
    schema = T.StructType([T.StructField(PART, T.IntegerType()), *(T.StructField(n, kinds[n]) for n in totals)])
    return table.sparkSession.createDataFrame([(r[PART], *(s[i] for s in sums)) for i, r in enumerate(rows)], schema)


def numbered(df: DataFrame, order: list[str | Column] | None = None, out: str = "id") -> DataFrame:
    """Ids 1..N by some columns, or in file order. Rows that are equal in the order get their ids in any order."""
    if out in df.columns:
        raise ValueError(f"{out} exists")
    table = stored(ordered(df, order) if order else _placed(df), "numbered")
    return table.join(F.broadcast(before(table, {"_n": F.count(F.lit(1))})), PART).withColumn(out, F.col(AT) + F.col("_n") + 1).drop(PART, AT, "_n")


def running_totals(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (name to column) over the whole table in that order, each row's own value included; nulls count as 0.

    A range is summed where it is sorted, as it is written; then the sums of the ranges before it are added."""
    placed = ordered(df, order)
    kind = lambda c: T.LongType() if isinstance(df.schema[c].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType) else T.DoubleType()
    cast = placed.withColumns({n: F.coalesce(F.col(c), F.lit(0)).cast(kind(c)) for n, c in sums.items()})
    at = [cast.columns.index(n) for n in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0] * len(at)
        for batch in batches:
            columns = list(batch.columns)
            for k, i in enumerate(at):
                columns[i] = pc.cumulative_sum(columns[i], start=pa.scalar(held[k], columns[i].type))
                if len(columns[i]):
                    held[k] = columns[i][-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    table = stored(cast.mapInArrow(run, cast.schema), "running")
    ends = before(table, {f"_{n}": F.max_by(n, AT) for n in sums})
    return table.join(F.broadcast(ends), PART).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(PART, AT, *(f"_{n}" for n in sums))
