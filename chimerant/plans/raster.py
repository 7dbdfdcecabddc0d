"""Plot pages as tables: packed image rows in, pixel columns out, by array functions and partial sums of columns.

A page is rows (page_id, y, rgb): rgb is the row's pixels as integers, the first channel in the highest of three bytes. What
expression.analyse_page() does with a whole image is here a profile of the page's columns (mean grey, largest blue score,
pixels with the signal, lowest pixel): rows of a page are summed where they are read, by whole arrays, and a page's sums
meet once; then the widest gap, both sides, the marker and the halves are slices of that profile, an array of as many
entries as the crop is wide. A pixel is never a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.plans.expression import BLUE_SCORE, EMPTY_GRAY, GRAY_WEIGHTS, MARGIN, MARKER, PLACES, ROWS

RASTER = "page_id string, y int, rgb array<int>"


def pack(page: np.ndarray) -> np.ndarray:
    """An image of three channels as integers."""
    p = page[..., :3].astype(np.int32)
    return (p[..., 0] << 16) | (p[..., 1] << 8) | p[..., 2]


def rasters(documents: DataFrame, render: Callable[[bytes], list[np.ndarray]]) -> DataFrame:
    """(page_id, y, rgb) of the pages of (path, content), cropped to the rows that are looked at; what can't be read is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = [pack(p) for p in render(content)]
                except Exception:  # noqa: BLE001 - one broken document must not end a run
                    continue
                for i, page in enumerate(pages):
                    part = page[ROWS[0] : ROWS[1]]
                    if len(part):
                        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                        rows = [pa.array([f"{path}#{i}"] * len(part)), pa.array(np.arange(ROWS[0], ROWS[0] + len(part), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))]
                        yield pa.RecordBatch.from_arrays(rows, ["page_id", "y", "rgb"])

    return documents.select("path", "content").mapInArrow(run, RASTER)


def _columns(packed: np.ndarray, y: np.ndarray, cfg: Config) -> list[np.ndarray]:
    """Of rows of a page: each column's sum of greys, largest blue score, pixels with the signal, and whether the lowest has it."""
    first, middle, last = ((packed >> b) & 255 for b in (16, 8, 0))
    red, blue = (last, first) if cfg.parity else (first, last)
    gray = np.rint(red * GRAY_WEIGHTS[0] + middle * GRAY_WEIGHTS[1] + blue * GRAY_WEIGHTS[2])
    signal = np.abs(gray - cfg.signal_gray) <= cfg.gray_tolerance
    return [gray.sum(0), (blue - (red + middle) // 2).max(0), signal.sum(0), signal[y == y.max()].any(0)]


_PART = pa.schema([("page_id", pa.string()), ("n", pa.int64()), ("y", pa.int32()), *((c, pa.list_(t)) for c, t in (("gray", pa.float64()), ("blue", pa.int32()), ("height", pa.int32()), ("bottom", pa.bool_())))])
_PROFILE = pa.list_(pa.struct([("x", pa.int32()), ("mean", pa.float64()), ("blue", pa.int32()), ("height", pa.int32()), ("bottom", pa.bool_())]))


def _parts(cfg: Config):
    """(page_id, y, rgb) to a row for each page and width of a batch: what its rows there say of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            width = np.diff(begin)
            ids = batch.column(0).dictionary_encode()
            code, y = ids.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            order = np.lexsort((width, code))
            for rows in np.split(order, np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(width[order]) != 0)) + 1):
                if not len(rows) or width[rows[0]] <= PLACES[0]:
                    continue
                stop = min(PLACES[1], int(width[rows[0]]))
                found = _columns(flat[begin[rows][:, None] + np.arange(PLACES[0], stop)], y[rows], cfg)
                cells = [pa.array([c], f.type) for c, f in zip(found, list(_PART)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids.dictionary[int(code[rows[0]])].as_py()], pa.string()), pa.array([len(rows)], pa.int64()), pa.array([y[rows].max()], pa.int32()), *cells], schema=_PART)

    return run


def _whole(parts: pa.Table) -> pa.Table:
    """The profile of a page from its parts."""
    rows = [[np.asarray(v.values) if hasattr(v, "values") else v for v in (parts.column(c)[i] for c in ("gray", "blue", "height", "bottom"))] for i in range(parts.num_rows)]
    longest = max(len(r[0]) for r in rows)
    n, gray, height, low = (np.zeros(longest) for _ in range(4))
    blue, bottom = np.full(longest, -256), np.zeros(longest, bool)
    low[:] = -np.inf
    for count, y, (g, b, h, signal) in zip(parts.column("n").to_pylist(), parts.column("y").to_pylist(), rows, strict=True):
        own = slice(0, len(g))
        n[own] += count
        gray[own] += g
        height[own] += h
        blue[own] = np.maximum(blue[own], b)
        bottom[own] = np.where(y > low[own], signal, np.where(y == low[own], bottom[own] | signal, bottom[own]))
        low[own] = np.maximum(low[own], y)
    columns = [pa.array(np.arange(longest, dtype=np.int32)), pa.array(gray / n), *(pa.array(c.astype(np.int32)) for c in (blue, height)), pa.array(bottom)]
    profile = pa.ListArray.from_arrays(pa.array([0, longest], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_PROFILE.value_type)))
    return pa.table([parts.column("page_id").slice(0, 1), profile], names=["page_id", "profile"])


def profiles(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(page_id, profile): the page's columns inside the crop, as an array of (x, mean, blue, height, bottom)."""
    crop = pages.filter(F.col("y").between(ROWS[0], ROWS[1] - 1) & F.col("page_id").isNotNull() & F.col("rgb").isNotNull()).select("page_id", "y", "rgb")
    # Rows of a page lie together as a rule, so most of this happens where they are read, and a page moves as one row or two.
    parts = crop.mapInArrow(_parts(cfg), "page_id string, n long, y int, gray array<double>, blue array<int>, height array<int>, bottom array<boolean>")
    return parts.groupBy("page_id").applyInArrow(_whole, "page_id string, profile array<struct<x:int,mean:double,blue:int,height:int,bottom:boolean>>")


#: The widest run of empty columns, the first of equals: (at, best) after a walk over the profile.
_GAP = f"""aggregate(profile, named_struct('x', 0, 'len', 0, 'best', 0, 'at', -1), (s, c) -> named_struct(
'x', s.x + 1, 'len', if(c.mean <= {EMPTY_GRAY}, 0, s.len + 1), 'best', if(c.mean <= {EMPTY_GRAY}, s.best, greatest(s.best, s.len + 1)), 'at', if(c.mean > {EMPTY_GRAY} AND s.len + 1 > s.best, s.x - s.len, s.at)))"""


def pixel_columns(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(page_id, side, half, x, bottom, height) as analyse_page() gives them; none for a page without a gap."""
    found = profiles(pages, cfg).withColumn("gap", F.expr(_GAP)).filter("gap.at >= 0")
    centre = found.withColumn("centre", F.expr("cast(floor((2 * gap.at + gap.best) / 2) as int)"))
    sides = centre.select("page_id", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.expr(f"slice(profile, 1, greatest(0, centre - {MARGIN}))").alias("part")),
        F.struct(F.lit(2).alias("side"), F.expr(f"slice(profile, centre + {MARGIN + 1}, size(profile))").alias("part")),
    )).alias("s")).select("page_id", "s.*")
    hits = sides.withColumn("hits", F.expr(f"filter(transform(part, (c, i) -> if(c.blue > {BLUE_SCORE}, i, -1)), i -> i >= 0)"))
    at = hits.withColumn("at", F.expr("if(size(hits) > 0, cast(floor(aggregate(hits, 0D, (s, i) -> s + i) / size(hits)) as int), cast(floor(size(part) / 2) as int))"))
    halves = at.select("page_id", "side", F.explode(F.array(
        F.struct(F.lit("L").alias("half"), F.expr("slice(part, 1, at)").alias("own")),
        F.struct(F.lit("R").alias("half"), F.expr(f"slice(part, at + {MARKER + 1}, size(part))").alias("own")),
    )).alias("h")).select("page_id", "side", "h.*")
    return halves.select("page_id", "side", "half", F.posexplode("own").alias("x", "c")).select("page_id", "side", "half", "x", "c.bottom", "c.height")
