"""Contrast-limited equalization of scan lines: histograms of tiles, and a lookup between four of them.

A page has a grid of tiles; each tile's counts are clipped, what was cut off goes back in even parts, and their running
sum is the tile's table of 256 values.  A pixel's value is interpolated between those of the four tiles around it.

Lines are dealt by page and sorted, and stream through a task.  Pages of up to `HELD` pixels wait there for their last
line, when their tables are known.  Of larger pages no more than the counts of the tiles are held: a first pass makes
their tables, 16 KB a page, which come before the page's lines in a second one.  So what moves is every line once, those
of large pages twice, and a page of any size takes bounded memory.

Where tiles do not divide a page, it is continued by mirrored lines and columns, or its last ones where it is small.
Lines (page_id, y, h, w, v) without pixels have none; (page_id, y) is to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.kernels.filters import level_tables, looked_up
from pageforge.operators.rasters import in_order, pages_of, pixels_of

# Tiles in each direction, levels.
GRID, LEVELS = 8, 256
#: Pixels of a page that waits in a task for its last line; bytes of pixels from which on lines are passed on.
HELD = 1 << 20
_PASSED = 1 << 21


class Tiles:
    """The counts of a page's tiles, from its lines in any parts."""

    def __init__(self, h: int, w: int, grid: int) -> None:
        self.h, self.w, self.grid = h, w, grid
        self.th, self.tw = -(-h // grid), -(-w // grid)
        mirror = min(h, w) > max(self.th * grid - h, self.tw * grid - w)
        shown = lambda n, size: np.concatenate([np.arange(n), 2 * (n - 1) - np.arange(n, size) if mirror else np.full(size - n, n - 1)])
        self.across = shown(w, self.tw * grid)
        self.again = shown(h, self.th * grid)[h:]  # the lines that continue the page
        self.counts = np.zeros(grid * grid * LEVELS, np.int64)

    def add(self, y: np.ndarray, lines: np.ndarray) -> None:
        wide = lines[:, self.across] if self.tw * self.grid > self.w else lines
        tile = np.arange(wide.shape[1]) // self.tw
        # A line counts where it lies and wherever it continues the page.
        which, at = np.nonzero(y[:, None] == self.again) if len(self.again) else (np.empty(0, int),) * 2
        for rows, down in ((slice(None), y), (which, at + self.h)):
            if len(down):
                code = (((down // self.th) * self.grid)[:, None] + tile) * LEVELS + wide[rows]
                self.counts += np.bincount(code.ravel(), minlength=len(self.counts))

    def tables(self, clip: float) -> np.ndarray:
        return level_tables(self.counts.reshape(-1, LEVELS), self.th * self.tw, clip).reshape(self.grid, self.grid, LEVELS)


def tables(self, clip: float) -> np.ndarray:
        return level_tables(self.counts.reshape(-1, LEVELS), self.th * self.tw, clip).reshape(self.grid, self.grid, LEVELS)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The parts of pages, and whether a page begins with one."""
    last = None
    for part in page_parts(batches):
        here = part.column("page_id")[0]
        yield part, last is None or here != last
        last = here


def tables(lines: DataFrame, clip: float, grid: int = GRID) -> DataFrame:
    """page_id, h, w and tables: grid * grid * 256 bytes."""
    kind = lines.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_arrays([head.column(c) for c in ("page_id", "h", "w")] + [pa.array([tiles.tables(clip).tobytes()])], ["page_id", "h", "w", "tables"])

        tiles = None
        for part, begins in pages_of(batches):
            if begins:
                if tiles:
                    yield made()
                head = part.slice(0, 1)
                tiles = Tiles(head.column("h")[0].as_py(), head.column("w")[0].as_py(), grid)
            tiles.add(part.column("y").to_numpy(), pixels_of(part, "v"))
        if tiles:
            yield made()

    rows = in_order(lines.where(F.size("v") > 0).select("page_id", "y", "h", "w", "v"))
    return rows.mapInArrow(run, f"page_id {kind}, h int, w int, tables binary")


def equalized(lines: DataFrame, clip: float, grid: int = GRID, held: int = HELD) -> DataFrame:
    """The lines with v equalized."""
    names = ["page_id", "y", "h", "w", "v"]
    kind = lines.schema["page_id"].dataType.simpleString()
    lines = lines.where((F.size("v") > 0) & F.col("page_id").isNotNull()).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, waiting, tiles, table = [], 0, [], None, None

        def draw(part):
            nonlocal size
            v = looked_up(pixels_of(part, "v"), part.column("y").to_numpy(), table, tiles.th, tiles.tw).astype(np.int32)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
            done.append([*(part.column(c) for c in names[:4]), pa.ListArray.from_arrays(ends, pa.array(v.ravel())).cast(pa.list_(pa.int32()))])
            size += v.nbytes

        def passed():
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done)], names)
            done.clear()
            return out

        def end():
            nonlocal table
            if waiting:
                table = tiles.tables(clip)
                for part in waiting:
                    draw(part)
                waiting.clear()

        for part, begins in pages_of(batches):
            if begins:
                end()
                tiles, table = Tiles(part.column("h")[0].as_py(), part.column("w")[0].as_py(), grid), None
                if part.column("tables")[0].is_valid:
                    table = np.frombuffer(part.column("tables")[0].as_py(), np.uint8).reshape(grid, grid, LEVELS)
                    part = part.slice(1)
            if table is not None:
                if part.num_rows:
                    draw(part)
            else:
                tiles.add(part.column("y").to_numpy(), pixels_of(part, "v"))
                waiting.append(part)
            if size >= _PASSED:
                yield passed()
                size = 0
        end()
        if done:
            yield passed()

    large = lines.where(F.col("h").cast("long") * F.col("w") > held)
    first = tables(large, clip, grid).select("page_id", F.lit(-1).alias("y"), "h", "w", F.lit(None).cast("array<int>").alias("v"), "tables")
    rows = in_order(lines.withColumn("tables", F.lit(None).cast("binary")).unionByName(first))
    return rows.mapInArrow(run, f"page_id {kind}, y int, h int, w int, v array<int>")
