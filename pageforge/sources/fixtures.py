"""Derived inputs: the driver's tables hold no images, so rasters, outlines and edits are computed from them.

They prove decisions and arithmetic, not image quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.functions import clip
from pageforge.operators.rasters import RASTER, packed

#: Bytes of pixels that a batch of painted pages holds.
HELD = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select(F.col("vec_id").alias("page_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, dealt out before anything is painted: a page is far larger than the vector that it is made of."""
    return _vectors(spark, sf_dir).select("page_id", "label", "e").repartition(4 * spark.sparkContext.defaultParallelism, "page_id")


def _lined(spark: SparkSession, sf_dir: str, names: tuple[str, ...], pixels: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Scan lines of 64 pixels (page_id, y, h, w, an array for each name, label) of a page of 64 by 64 for each vector.

    `pixels` gives a plane for each name from ids and labels [n, 1, 1] and components down [n, 64, 1] and across
    [n, 1, 64].  Where a number is null, pixels are 255, as greatest and least skip nulls; NaN counts as 0.
    """
    edge, kind = 64, pa.list_(pa.int32())
    some = HELD // (edge * edge * 4 * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, some):
                b = whole.slice(start, some)
                n = b.num_rows
                ids, labels = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, 1, 1) for c in ("page_id", "label"))
                flat = b.column("e").flatten()
                e = flat.to_numpy(zero_copy_only=False).reshape(n, edge)
                known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(n, edge) & b.column("label").is_valid().to_numpy(zero_copy_only=False)[:, None]
                planes = []
                for plane, of in pixels(ids, labels, e[:, :, None], e[:, None, :]):
                    v = np.nan_to_num(np.clip(np.floor(np.broadcast_to(plane, (n, edge, edge))), 0, 255), copy=False)
                    if not known.all():
                        v[np.broadcast_to(~of(known[:, :, None], known[:, None, :]), v.shape)] = 255
                    planes.append(pa.ListArray.from_arrays(pa.array(np.arange(n * edge + 1, dtype=np.int32) * edge), pa.array(v.astype(np.int32).ravel())).cast(kind))
                at = pa.array(np.repeat(np.arange(n), edge))
                size = pa.array(np.full(n * edge, edge, np.int32))
                yield pa.RecordBatch.from_arrays([b.column("page_id").take(at), pa.array(np.tile(np.arange(edge, dtype=np.int32), n)), size, size, *planes, b.column("label").take(at)], ["page_id", "y", "h", "w", *names, "label"])

    planes = ", ".join(f"{c} array<int>" for c in names)
    return _dealt(spark, sf_dir).mapInArrow(run, f"page_id long, y int, h int, w int, {planes}, label long")


def _down(down: np.ndarray, _) -> np.ndarray:
    return down


def _across(_, across: np.ndarray) -> np.ndarray:
    return across


def gray64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan lines of a gray page of 64 by 64 for each vector: its components summed pairwise, scaled by label and id."""
    return _lined(spark, sf_dir, ("v",), lambda ids, labels, down, across: [(28 * labels + 10 + 5 * (1 + np.fmod(ids, 8)) * (down + across), np.logical_and)])


def rasters64(spark: SparkSession, sf_dir: str, color: bool = False) -> DataFrame:
    """page_id and packed raster of the pages of `gray64` or `color64`."""

    def pixels(page_id: int, label: int, e: np.ndarray) -> np.ndarray:
        down, across = e[:, None], e[None, :]
        if color:
            base, tint = 172 + 8 * label, 4 * (1 + page_id % 12)
            planes = (base + tint * down + 0 * across, base + tint * across + 0 * down, base + 4 + tint * (across + down) / 2)
        else:
            planes = (28 * label + 10 + 5 * (1 + page_id % 8) * (down + across),) * 3
        return np.stack(planes, 2)

    return _painted(spark, sf_dir, pixels)


def rasters8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and packed raster of the pages of `gray8`."""
    return _painted(spark, sf_dir, lambda _, __, e: np.repeat((e.reshape(8, 8, 1) + 0.6) * 212.5, 3, 2))


def _paint(batches: Iterator[pa.RecordBatch], pixels: Callable[[int, int, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The pages of vectors, in batches of about HELD bytes however many vectors come at once."""
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
    for b in batches:
        ids, start, pages, size = b.column("page_id"), 0, [], 0
        flat = b.column("e").flatten()
        rows = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows and not flat.null_count else None
        for k, (page_id, label) in enumerate(zip(ids.to_pylist(), b.column("label").to_pylist())):
            e = np.array(b.column("e")[k].as_py()) if rows is None else rows[k]
            pages.append(packed(np.clip(np.floor(pixels(page_id, label, e)), 0, 255).astype(np.uint8)))
            size += len(pages[-1]["data"])
            if size >= HELD or k + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(pages)), pa.array(pages, kind)], ["page_id", "raster"])
                start, pages, size = k + 1, [], 0


def _painted(spark: SparkSession, sf_dir: str, pixels: Callable[[int, int, np.ndarray], np.ndarray]) -> DataFrame:
    return _dealt(spark, sf_dir).mapInArrow(lambda batches: _paint(batches, pixels), f"page_id long, {RASTER}")


def gray8(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """Scan lines of a gray page of 8 by 8 for each vector; `noisy` pages differ in strength, so that every branch occurs."""
    rows = _vectors(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    part = F.slice("e", F.col("y") * 8 + 1, F.lit(8))
    if noisy:
        pixel = lambda v: F.floor(128 + 212.5 * v * (1 + F.col("page_id") % 10) / 40)
    else:
        pixel = lambda v: F.floor((v + 0.6) * 212.5)
    v = F.transform(part, lambda x: clip(pixel(x), 0, 255).cast("int"))
    return rows.select("page_id", "y", F.lit(8).alias("h"), F.lit(8).alias("w"), v.alias("v"))


def color64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan lines of a colour page of 64 by 64 for each vector: bright paper with more or less tint."""

    def pixels(ids, labels, down, across):
        base, tint = 172 + 8 * labels, 4 * (1 + np.fmod(ids, 12))
        return [(base + tint * down, _down), (base + tint * across, _across), (base + 4 + tint * (across + down) / 2, np.logical_and)]

    return _lined(spark, sf_dir, ("b", "g", "r"), pixels).drop("label")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, w, h, pts: four scrambled corners for each vector."""
    rows = _vectors(spark, sf_dir)
    inset, jitter = 10.0 + 20 * F.col("label"), 60.0 * (1 + F.col("page_id") % 20)
    at = lambda i: F.get("e", F.lit(i))
    points = []
    for c in range(4):
        x = F.when(F.lit(c in (0, 3)), inset).otherwise(1000.0 - inset) + jitter * at(2 * c)
        y = F.when(F.lit(c in (0, 1)), inset).otherwise(1000.0 - inset) + jitter * at(2 * c + 1)
        points.append(F.struct(((c + F.col("page_id") % 4) % 4).alias("slot"), x.alias("x"), y.alias("y")))
    pts = F.transform(F.array_sort(F.array(*points)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rows.select("page_id", F.lit(1000).alias("w"), F.lit(1000).alias("h"), pts.alias("pts"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log: page_id, at, seq, op, degrees, mode, on, corners; all arguments come from one number of the event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    op = F.when(kind == "click", "recrop").when(kind == "view", "rotate").when(kind == "error", "demoire").when(kind == "signup", "mode").when(k == 0, "delete").otherwise("export")
    near, far = k / 400.0, 1.0 - k / 400.0
    return e.select(
        F.col("user_id").alias("page_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        (90 * (k % 4)).cast("int").alias("degrees"),
        F.element_at(F.array(F.lit("color"), F.lit("gray"), F.lit("bw")), (k % 3 + 1).cast("int")).alias("mode"),
        (k % 2 == 1).alias("on"),
        F.array(F.array(near, near), F.array(far, near), F.array(far, far), F.array(near, far)).alias("corners"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sessions from order lines; the id is a digest of the whole row, as no shorter key is unique."""
    row = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return row.select(
        F.md5(F.concat_ws("|", *[F.col(c).cast("long").cast("string") for c in key])).alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").cast("int").alias("order"),
        (F.col("l_returnflag") == "R").alias("deleted"),
        (F.col("l_linestatus") == "O").alias("passthrough"),
        (100 - F.round(F.col("l_discount") * 500).cast("int")).alias("confidence_pct"),
        F.col("l_shipdate").alias("created_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sessions from conversations: a gray page for each turn, 64 bytes of its text a line, the system's deleted."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    height = F.floor((F.octet_length(data) + 63) / 64).cast("int")
    fill = F.unhex(F.repeat(F.lit("FF"), height * 64 - F.octet_length(data)))
    raster = F.struct(height.alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.concat(data, fill).alias("data"))
    row = table(spark, sf_dir, "conversations")
    return row.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").cast("string").alias("id"),
        F.col("turn").alias("order"),
        (F.col("role") == "system").alias("deleted"),
        F.lit(False).alias("passthrough"),
        F.lit(None).cast("binary").alias("pdf"),
        raster.alias("raster"),
    )


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge pixels (page_id, y, x) of three parallel lines for each vector, 48 pixels wide, sloping by its first component."""
    rows = _vectors(spark, sf_dir).select("page_id", F.floor(F.get("e", F.lit(0)) * 96).alias("slope"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    rows = rows.select("page_id", "slope", "k", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("x"))
    return rows.select("page_id", (40 * F.col("k") + F.floor(F.col("x") * F.col("slope") / 64)).alias("y"), "x")
