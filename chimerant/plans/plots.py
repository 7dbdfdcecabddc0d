"""Coverage of events from documents of plot pages, each page rendered once.

A renderer takes a document's bytes and returns a list of (image, text), one for each page. What it gives becomes a table of
image rows and texts in the shared folder; metadata come from the texts, pixel columns from the rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.operators.storage import stored
from chimerant.plans import expression, raster
from chimerant.plans.assemble import KEYS
from chimerant.sources.matrix import store_of
from chimerant.sources.tables import PAGE_METRICS, page_fields

Render = Callable[[bytes], list[tuple[np.ndarray, str]]]
_RENDERED = f"{raster.RASTER}, text string, failed string"


def rendered(documents: DataFrame, render: Render) -> DataFrame:
    """(page_id, y, rgb, text, failed): a row for each image row that is looked at, one with the text (y null) for each page, and one
    for each document that could not be read."""
    first, last = expression.ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for i, (image, text) in enumerate(render(content)):
                        packed = raster.pack(image)
                        rows.append((f"{path}#{i}", None, None, text or "", None))
                        rows += [(f"{path}#{i}", y, packed[y].tolist(), None, None) for y in range(first, min(last, len(packed)))]
                except Exception as e:  # noqa: BLE001 - one broken document must not end a run
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=["page_id", "y", "rgb", "text", "failed"]).astype({"y": "Int32"})

    return documents.select("path", "content").mapInPandas(run, _RENDERED)


def analyse(documents: DataFrame, render: Render, features: DataFrame, symbols: DataFrame, cfg: Config = Config(), pictures_in: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Coverage of each page, with the keys that events join on, and (document, failed) of those that could not be read.

    documents: (path, content); features: all features of the annotation; symbols: the genes that texts may name;
    pictures_in: a folder for pictures of the pages."""
    table = stored(rendered(documents, render), "pages")
    if pictures_in:
        save_pictures(pictures(table, cfg), pictures_in)
    fields = page_fields(table.filter("text IS NOT NULL").select("page_id", "text"), symbols)
    exons = expression.exons(raster.pixel_columns(table.filter("rgb IS NOT NULL").select("page_id", "y", "rgb"), cfg), fields.select("page_id", "max_height"), cfg)
    out = expression.coverage(exons, expression.with_strands(fields, features))
    cells = [c for s in (1, 2) for c in (*PAGE_METRICS[4 * s - 4 : 4 * s], f"coverage{s}")]
    pages = out.select("page_id", *KEYS, "max_height", "strand1", "strand2", *cells)
    return stored(pages, "coverage"), table.filter("failed IS NOT NULL").select(F.col("page_id").alias("document"), "failed")


def for_events(pages: DataFrame) -> DataFrame:
    """The table that joins with events: keys, metrics and coverage, each row once."""
    return pages.drop("page_id", "max_height", "strand1", "strand2").distinct()


GAP = 20  # white columns between the two histograms of a picture


def png(rgb: np.ndarray) -> bytes:
    """An image as a PNG file: eight bits a channel, no filter."""
    height, width = rgb.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, -1)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def drawn(page: np.ndarray, cfg: Config = Config()) -> np.ndarray | None:
    """Both histograms side by side, the bounds of exons in green and the marker in blue; None for a page without a gap."""
    sides = expression.halves_of(expression.ordered(page, cfg.parity))
    if sides is None or not all(s.size for s in sides):
        return None
    out = []
    for part in sides:
        picture, at = part.copy(), expression.blue_column(part)
        bottom = np.r_[False, expression.normalise(expression.gray_of(part), cfg)[-1] == cfg.signal_gray, False].astype(int)
        bottom[[at + 1, min(at + 2, len(bottom) - 1)]] = 0  # the marker belongs to no exon
        edges = np.flatnonzero(np.diff(bottom))
        picture[:, np.minimum(edges, part.shape[1] - 1)] = (0, 255, 0)
        picture[:, at : at + expression.MARKER] = (0, 0, 255)
        out.append(picture)
    return np.concatenate([out[0], np.full((out[0].shape[0], GAP, 3), 255, np.uint8), out[1]], 1)


def pictures(table: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(page_id, png) of rendered pages, for people who want to see where exons were found. table: rendered(), stored."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack([np.asarray(r, np.int32) for r in rows["rgb"]])
        page = np.zeros((expression.ROWS[1], packed.shape[1], 3), np.uint8)
        page[rows["y"].to_numpy()] = np.stack([(packed >> b) & 255 for b in (16, 8, 0)], -1)
        picture = drawn(page, cfg)
        return pd.DataFrame([] if picture is None else [(rows["page_id"].iloc[0], png(picture))], columns=["page_id", "png"])

    return table.filter("rgb IS NOT NULL").groupBy("page_id").applyInPandas(run, "page_id string, png binary")


def save_pictures(found: DataFrame, folder: str, filesystem: str | None = None) -> int:
    """A file for each picture, named by its document and page; a task that runs again writes the same files. Tells how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder, filesystem)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = [re.sub(r"[^\w.-]+", "_", p.rsplit("/", 1)[-1]) + ".png" for p in batch["page_id"]]
            for name, content in zip(names, batch["png"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield pd.DataFrame({"name": names})

    return found.mapInPandas(run, "name string").count()
