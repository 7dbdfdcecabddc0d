"""Coverage of both partners from plot pages: pixel columns to exons to ratios.

Pages come as a long table (page_id, side 1/2, half 'L'/'R', x, bottom, height): per pixel column, whether its lowest
pixel has the signal's grey and how many pixels have. analyse_page() makes these columns of a page's grey image;
documents are rendered by a pluggable function, as no renderer is part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.operators.joins import lookup

# Rows and columns of a page that hold its histograms, the mean grey above which a column is empty, the
# margin cut on both sides of the gap's centre, the score above which a column is the marker, and the marker's width.
ROWS, PLACES = (250, 334), (220, 1600)
EMPTY_GRAY, MARGIN, BLUE_SCORE, MARKER = 240, 33, 100, 2
# Weights of the channels in grey, in the order red, green, blue.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
COLUMNS = "page_id string, side int, half string, x int, bottom boolean, height int"


def normalise(gray: np.ndarray, cfg: Config = Config()) -> np.ndarray:
    """Pixels within the tolerance get the signal's grey."""
    out = gray.copy()
    out[np.abs(gray.astype(int) - cfg.signal_gray) <= cfg.gray_tolerance] = cfg.signal_gray
    return out


def ordered(page: np.ndarray, parity: bool = True) -> np.ndarray:
    """The page's channels as red, green, blue. Published runs read the first channel of a page as blue, the third as red."""
    return page[..., 2::-1] if parity else page[..., :3]


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array(GRAY_WEIGHTS)).astype(np.uint8)


def blue_column(rgb: np.ndarray) -> int:
    """Mean place of clearly blue columns; the centre if there are none. Blue is scored against the mean of the others."""
    red, green, blue = np.moveaxis(rgb.astype(int), -1, 0)
    hit = np.flatnonzero((blue - (red + green) // 2).max(axis=0, initial=-255) > BLUE_SCORE)
    return int(hit.mean()) if len(hit) else rgb.shape[1] // 2


def widest_gap(filled: np.ndarray) -> tuple[int, int] | None:
    """(start, length) of the longest run of empty places, the first of equals."""
    edges = np.diff(np.r_[0, (~filled).astype(int), 0])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return None
    i = int(np.argmax(ends - starts))
    return int(starts[i]), int(ends[i] - starts[i])


def halves_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The left and right histogram of a whole page, beside the centre of the widest empty gap; None without a gap."""
    part = rgb[slice(*ROWS), slice(*PLACES)]
    gap = widest_gap(gray_of(part).mean(axis=0) <= EMPTY_GRAY) if part.size else None
    if gap is None:
        return None
    centre = (2 * gap[0] + gap[1]) // 2
    return part[:, : max(0, centre - MARGIN)], part[:, centre + MARGIN :]


def analyse_page(page_id: str, page: np.ndarray, cfg: Config = Config()) -> pd.DataFrame:
    """The pixel columns of both histograms, halved at their breakpoints; none if the page has no gap between them."""
    rows = []
    for side, part in enumerate(halves_of(ordered(page, cfg.parity)) or (), start=1):
        gray = normalise(gray_of(part), cfg)
        at = blue_column(part) if part.size else 0
        for half, image in (("L", gray[:, :at]), ("R", gray[:, at + MARKER :])):
            hit = image == cfg.signal_gray
            rows += [(page_id, side, half, x, bool(hit[-1, x]), int(hit[:, x].sum())) for x in range(image.shape[1])]
    return pd.DataFrame(rows, columns=["page_id", "side", "half", "x", "bottom", "height"])


def pixel_columns(documents: DataFrame, render: Callable[[bytes], list[np.ndarray]], cfg: Config = Config()) -> DataFrame:
    """Pixel columns of all pages of (path, content); a page or document that can't be read is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = render(content)
                except Exception:  # noqa: BLE001 - one broken document must not end a run
                    continue
                for i, rgb in enumerate(pages):
                    yield analyse_page(f"{path}#{i}", rgb, cfg)

    return documents.select("path", "content").mapInPandas(run, COLUMNS)


def exons(columns: DataFrame, heights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(page_id, side, half, start, mean, median) of each exon: a run of columns whose lowest pixel has the signal.

    heights: (page_id, max_height); without a height, reads are 0."""
    hit = columns.filter("bottom")
    w = Window.partitionBy("page_id", "side", "half").orderBy("x")
    run = hit.withColumn("island", F.col("x") - F.row_number().over(w)).join(heights, "page_id", "left")
    reads = F.when(F.coalesce("max_height", F.lit(0)) > 0, F.col("height") * (F.col("max_height") / cfg.max_pixels)).otherwise(0.0)
    return run.groupBy("page_id", "side", "half", "island").agg(F.min("x").alias("start"), F.bround(F.avg(reads), 2).alias("mean"), F.bround(F.median(reads), 2).alias("median")).drop("island")


def with_strands(pages: DataFrame, features: DataFrame) -> DataFrame:
    """pages with strand1 and strand2, those of their transcripts; null where a transcript is unknown."""
    one = features.filter("transcript_id IS NOT NULL").groupBy("transcript_id").agg(F.min("strand").alias("strand"))
    for s in (1, 2):
        pages = lookup(pages, one, f"transcript_id{s}", "transcript_id", {"strand": f"strand{s}"})
    return pages


def coverage(exon_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: means and medians of what is retained and lost, and their ratios.

    On the plus strand the first partner retains the left half, the second the right one; on minus it is the other way.
    pages: page_id, strand1, strand2, transcript_id1, transcript_id2 and any columns to keep."""
    halves = exon_rows.groupBy("page_id", "side", "half").agg(F.bround(F.avg("mean"), 3).alias("mean"), F.bround(F.avg("median"), 3).alias("median"))
    cells = {f"{s}{h}": (s, h) for s in (1, 2) for h in "LR"}
    wide = halves.groupBy("page_id").agg(*(F.max(F.when((F.col("side") == s) & (F.col("half") == h), F.col(m))).alias(f"_{m}_{k}") for k, (s, h) in cells.items() for m in ("mean", "median")))
    out = pages.join(wide, "page_id", "left")
    for s in (1, 2):
        strand, known = F.col(f"strand{s}"), F.col(f"transcript_id{s}").isNotNull()
        for m in ("mean", "median"):
            left, right = (F.coalesce(F.col(f"_{m}_{s}{h}"), F.lit(0.0)) for h in "LR")
            first, second = (left, right) if s == 1 else (right, left)
            retained = F.when(known & (strand == "+"), first).when(known & (strand == "-"), second).otherwise(0.0)
            lost = F.when(known & (strand == "+"), second).when(known & (strand == "-"), first).otherwise(0.0)
            out = out.withColumns({f"{m}_retained{s}": retained, f"{m}_lost{s}": lost})
        out = with_ratio(out, s)
    return out.drop(*[c for c in out.columns if c.startswith("_m")])


def with_ratio(df: DataFrame, s: int) -> DataFrame:
    a, b = F.col(f"mean_retained{s}"), F.col(f"mean_lost{s}")
    return df.withColumn(f"coverage{s}", F.when((a != 0) & (b != 0), F.bround(a / F.nullif(b, F.lit(0.0)), 3)).otherwise(0.0))
