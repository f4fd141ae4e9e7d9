"""Page rasters as relations.

A packed raster is a struct (height, width, nChannels, mode, data) as Spark's image source gives it, BGR by rows;
`per_page` runs numpy over one after the other inside Arrow batches.  A page can become scan lines too: one row per line
with its pixels in arrays.  Neighbours within a line are array elements, neighbours between lines come from lag and lead
over the page's lines, so a stencil needs one sort by (page, line) and no join, and a page of any size is many small rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pageforge.functions import gray


RASTER = "raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>"


def unpacked(raster: dict | None) -> np.ndarray | None:
    """[height, width, (b, g, r)] of a packed raster, None where it has no pixels; gray counts for all channels, alpha goes."""
    if raster is None or not raster["height"] or not raster["width"] or raster["data"] is None:
        return None
    page = np.frombuffer(raster["data"], np.uint8).reshape(raster["height"], raster["width"], -1)
    return np.repeat(page, 3, axis=2) if page.shape[2] == 1 else page[..., :3]


def packed(page: np.ndarray) -> dict:
    return {"height": page.shape[0], "width": page.shape[1], "nChannels": 3, "mode": 16, "data": page.tobytes()}


def per_page(pages: DataFrame, run: Callable[[np.ndarray, dict], dict], adds: str, needs: tuple[str, ...] = (), empty: dict | None = None) -> DataFrame:
    """Adds (or replaces) the columns `adds` by run(page, needed columns); rows without pixels get `empty`, else nulls."""
    new = T._parse_datatype_string(adds)
    kept = [f for f in pages.schema.fields if f.name not in new.fieldNames()]
    arrow, names = to_arrow_schema(new), new.fieldNames()
    wanted = ["raster", *needs]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in wanted}
                page = unpacked(row["raster"])
                if page is None:
                    rows.append({"raster": row["raster"]} | (empty or {}))
                else:
                    rows.append(run(page, row))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names], [f.name for f in kept] + names)

    return pages.mapInArrow(go, T.StructType([*kept, *new.fields]))


def scan_lines(pages: DataFrame, raster: str = "raster", page_id: str = "page_id") -> DataFrame:
    """page_id, y, h, w and the byte arrays b, g, r of every line of packed BGR rasters, some lines of a page at a time."""
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = unpacked(batch.column("raster")[i].as_py())
                for y in range(0, 0 if page is None else len(page), 256):
                    part = page[y : y + 256].astype(np.int32)
                    n, w = part.shape[:2]
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * w)
                    planes = [pa.ListArray.from_arrays(ends, part[..., k].ravel()).cast(kind) for k in range(3)]
                    whole = lambda v: pa.array(np.full(n, v, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").take(whole(i)), pa.array(np.arange(y, y + n, dtype=np.int32)), whole(len(page)), whole(w), *planes], ["page_id", "y", "h", "w", "b", "g", "r"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(raster).alias("raster"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, y int, h int, w int, b array<int>, g array<int>, r array<int>")


def in_order(lines: DataFrame) -> DataFrame:
    """Scan lines dealt by page, a page's lines one after the other in their task."""
    return lines.repartition("page_id").sortWithinPartitions("page_id", "y")


def page_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of lines in order, each of one page; a page has one part or more."""
    for b in batches:
        if b.num_rows:
            ids = b.column("page_id")
            cuts = [0, *(np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                yield b.slice(i, j - i)


def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The parts of pages, and whether a page begins with one."""
    last = None
    for part in page_parts(batches):
        here = part.column("page_id")[0]
        yield part, last is None or here != last
        last = here


def pixels_of(lines: pa.RecordBatch, name: str) -> np.ndarray:
    """[lines, pixels] of lines of the same width."""
    return lines.column(name).flatten().to_numpy(zero_copy_only=False).reshape(lines.num_rows, -1)


def pack(lines: DataFrame) -> DataFrame:
    """The packed rasters of scan lines with b, g, r."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    pixels = F.transform(F.arrays_zip("b", "g", "r"), lambda p: F.concat(byte(p["b"]), byte(p["g"]), byte(p["r"])))
    lines = lines.select("page_id", "y", "h", "w", F.array_join(pixels, "").alias("line"))
    whole = lines.groupBy("page_id").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    data = F.unhex(F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return whole.select("page_id", F.struct(F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data")).alias("raster"))


def per_pixel(f) -> Column:
    """An array of f(b, g, r) over a line."""
    return F.transform(F.arrays_zip("b", "g", "r"), lambda p: f(p["b"], p["g"], p["r"]))


def gray_lines(lines: DataFrame) -> DataFrame:
    return lines.select("page_id", "y", "h", "w", F.transform(per_pixel(gray), lambda v: v.cast("int")).alias("v"))


def line_above(name: str, mirror: bool) -> Column:
    """The line before; at the top the line after (mirrored border) or the line itself (replicated border)."""
    w = Window.partitionBy("page_id").orderBy("y")
    return F.coalesce(F.lag(name).over(w), F.lead(name).over(w) if mirror else F.col(name), F.col(name))


def line_below(name: str, mirror: bool) -> Column:
    w = Window.partitionBy("page_id").orderBy("y")
    return F.coalesce(F.lead(name).over(w), F.lag(name).over(w) if mirror else F.col(name), F.col(name))


def neighbours(line: Column, f, mirror: bool) -> Column:
    """An array of f(left, here, right) over a line."""
    last = F.size(line) - 1

    def at(v: Column, i: Column) -> Column:
        left = F.when(i > 0, i - 1).otherwise(F.least(F.lit(1), last) if mirror else F.lit(0))
        right = F.when(i < last, i + 1).otherwise(F.greatest(last - 1, F.lit(0)) if mirror else last)
        return f(F.get(line, left), v, F.get(line, right))

    return F.transform(line, at)


def tile_parts(lines: DataFrame, name: str, grid: int) -> DataFrame:
    """Each line cut into the segments of its tiles: page_id, ty, tx, part.

    Tiles are max(1, size // grid) wide and high; what is left over at the right and bottom makes further whole tiles
    or is not looked at.
    """
    th, tw = (F.greatest(F.lit(1), F.floor(F.col(c) / grid)).cast("int") for c in ("h", "w"))
    lines = lines.withColumns({"th": th, "tw": tw})
    lines = lines.withColumn("ty", F.floor(F.col("y") / F.col("th")).cast("int")).where((F.col("ty") + 1) * F.col("th") <= F.col("h"))
    lines = lines.withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") / F.col("tw")).cast("int") - 1)))
    return lines.select("page_id", "ty", "tx", F.slice(F.col(name), F.col("tx") * F.col("tw") + 1, F.col("tw")).alias("part"))


def add_up(array: Column, kind: str = "double") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda s, x: s + x)
