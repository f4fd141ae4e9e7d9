"""Statistics of pages over scan lines: sharpness, glare, noise, levels, chroma; what is decided from measures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.functions import flags
from pageforge.kernels import color, light
from pageforge.operators.rasters import add_up, in_order, line_above, line_below, neighbours, page_parts, pages_of, pixels_of


class _Tiles:
    """Energy and blown out pixels of the tiles of one page, from its lines in any parts; holds two lines and the sums."""

    def __init__(self, h: int, w: int, s: Settings) -> None:
        self.s, self.h, self.w = s, h, w
        self.th, self.tw = (max(1, n // s.gate.grid) for n in (h, w))
        self.down, self.across = h // self.th, w // self.tw
        self.energy, self.hot, self.lines = np.zeros((self.down, self.across)), np.zeros((self.down, self.across)), np.zeros(self.down)
        self.held, self.y, self.begun = np.empty((0, w)), np.empty(0, int), False

    def _add(self, into: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        ty = y // self.th
        by_tile = values[:, : self.across * self.tw].reshape(len(y), self.across, self.tw).sum(2)
        np.add.at(into, ty[ty < self.down], by_tile[ty < self.down])

    def add(self, y: np.ndarray, v: np.ndarray) -> None:
        self._add(self.hot, y, v >= self.s.gate.glare_value)
        np.add.at(self.lines, (ty := y // self.th)[ty < self.down], 1)
        self.held, self.y = np.concatenate([self.held, v]), np.concatenate([self.y, y])
        if len(self.held) > 2:
            self._squared(last=False)

    def _squared(self, last: bool) -> None:
        """The squared gradients of lines with a line on either side; at the ends of a page the other side's line counts twice."""
        v, y = self.held, self.y
        if not self.begun:
            v, y, self.begun = np.concatenate([v[1:2] if len(v) > 1 else v, v]), np.concatenate([y[:1], y]), True
        if last:
            v, y = np.concatenate([v, v[-2:-1]]), np.concatenate([y, y[-1:]])
        p = np.pad(v, ((0, 0), (1, 1)), "reflect" if self.w > 1 else "edge")
        dx, sx = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * v + p[:, 2:]
        self._add(self.energy, y[1:-1], np.square(dx[:-2] + 2 * dx[1:-1] + dx[2:]) + np.square(sx[2:] - sx[:-2]))
        self.held, self.y = v[-2:], y[-2:]

    def measures(self) -> tuple[float, int, int]:
        self._squared(last=True)
        size = self.lines[:, None] * self.tw
        means = sorted((self.energy / size).ravel().tolist(), reverse=True)
        best = means[: max(1, int(len(means) * self.s.gate.content))]
        return sum(best) / len(best), int((self.hot / size >= self.s.gate.glare_share).sum()), max(self.h, self.w)


def measured(gray: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id, sharpness (the mean squared Sobel gradient of the busiest tenth of the tiles), glare_hot_tiles (tiles in
    which most pixels are blown out), long_edge.

    A page's lines stream through a task in order; the sums of its tiles, a bounded number, and two lines are held.
    """
    kind = gray.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, page = [], [], None

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.float64(), pa.int32(), pa.int32())))], ["page_id", "sharpness", "glare_hot_tiles", "long_edge"])
            ids.clear(), rows.clear()
            return out

        for part, begins in pages_of(batches):
            if begins:
                if page:
                    rows.append(page.measures())
                if len(rows) >= 1000:
                    yield passed()
                page = _Tiles(part.column("h")[0].as_py(), part.column("w")[0].as_py(), s)
                ids.append(part.column("page_id").slice(0, 1))
            page.add(part.column("y").to_numpy(), pixels_of(part, "v").astype(np.float64))
        if page:
            rows.append(page.measures())
            yield passed()

    rows = in_order(gray.where(F.size("v") > 0).select("page_id", "y", "h", "w", "v"))
    return rows.mapInArrow(run, f"page_id {kind}, sharpness double, glare_hot_tiles int, long_edge int")


def sharpness(gray: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id, sharpness."""
    return measured(gray, s).select("page_id", "sharpness")


def gate(gray: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id, sharpness, glare_hot_tiles, long_edge, flags, passed.  Flags never block a page."""
    found = flags((F.col("sharpness") < s.gate.sharp, "blur"), (F.col("glare_hot_tiles") > s.gate.glare_tiles, "glare"), (F.col("long_edge") < s.ingest.low_edge, "low_resolution"))
    return measured(gray, s).withColumn("flags", found).withColumn("passed", F.size("flags") == 0)


def noise_sigma(gray: DataFrame) -> DataFrame:
    """page_id, sigma: a fast estimate of Gaussian noise from the Laplacian difference over all pixels; 0 below 3 by 3."""
    lines = gray.withColumn("c", neighbours(F.col("v"), lambda a, b, c: (a - 2 * b + c).cast("double"), mirror=False))
    lines = lines.withColumns({"up": line_above("c", False), "down": line_below("c", False)})
    row = add_up(F.transform(F.arrays_zip("up", "c", "down"), lambda p: F.abs(p["up"] - 2 * p["c"] + p["down"])))
    sums = lines.withColumn("row", row).groupBy("page_id").agg(F.sum("row").alias("all"), F.first("h").alias("h"), F.first("w").alias("w"))
    sigma = F.col("all") * math.sqrt(0.5 * math.pi) / (6.0 * (F.col("w") - 2) * (F.col("h") - 2))
    return sums.select("page_id", F.when((F.col("h") < 3) | (F.col("w") < 3), 0.0).otherwise(sigma).alias("sigma"))


def adaptive_columns(s: Settings = SETTINGS) -> dict[str, Column]:
    """Denoising, sharpening and routing from the columns sigma and moire; decided on the values as measured, rounded after."""
    a, sigma, moire_ = s.adaptive, F.col("sigma"), F.col("moire")
    routed = moire_ >= a.moire
    mode = F.when(sigma < a.skip, "none").when(sigma < a.heavy, "bilateral").otherwise("nlm")
    color = F.when(sigma < a.skip, 0).when(sigma < a.light, a.light_color).when(sigma < a.heavy, a.strong_color).otherwise(0)
    amount = F.when(sigma < a.skip, a.amounts[0]).when(sigma < a.heavy, a.amounts[1]).otherwise(a.amounts[2])
    return {
        "noise_sigma": F.bround(sigma, 2),
        "moire_score": F.bround(moire_, 2),
        "denoise": F.struct(mode.alias("mode"), color.alias("sigma_color")),
        "sharpen": F.struct(F.when(routed, F.least(amount, F.lit(a.moire_amount))).otherwise(amount).alias("amount"), F.lit(a.radius).alias("radius")),
        "route_demoire": routed,
    }


def adaptive(measured: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id and the columns of `adaptive_columns`."""
    return measured.select("page_id", *[c.alias(n) for n, c in adaptive_columns(s).items()])


def counts_of(lines: DataFrame, name: str = "v") -> DataFrame:
    """page_id, value, n: the histogram of each page, at most 256 rows a page."""
    return lines.select("page_id", F.explode(name).alias("value")).groupBy("page_id", "value").agg(F.count("*").alias("n"))


def levels(plane: DataFrame, low: float, high: float) -> DataFrame:
    """page_id, lo, hi: exact percentiles of each page, from its histogram."""
    both = F.percentile("value", [low / 100, high / 100], F.col("n"))
    return counts_of(plane).groupBy("page_id").agg(both.alias("p")).select("page_id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def edge_thresholds(gray: DataFrame) -> DataFrame:
    """page_id, low, high: a third around the median, for edge detection."""
    middle = counts_of(gray).groupBy("page_id").agg(F.percentile("value", 0.5, F.col("n")).alias("m"))
    low, high = F.greatest(F.lit(0.0), (1.0 - 0.33) * F.col("m")), F.least(F.lit(255.0), (1.0 + 0.33) * F.col("m"))
    return middle.select("page_id", F.col("m").alias("median"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def chroma(colors: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id, sum_a, sum_b, colored (pixels with any colour left) of lines with b, g, r, after chroma is drawn toward neutral where it is weak."""
    c, some = s.light, 1 << 14  # pixels at a time, so that their doubles stay in the cache
    kind = colors.schema["page_id"].dataType.simpleString()

    names = ("sum_a", "sum_b", "colored")

    def sums(part: pa.RecordBatch) -> np.ndarray:
        found, planes = np.zeros(3, np.int64), [part.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.uint8) for n in "bgr"]
        for i in range(0, len(planes[0]), some):
            out = light.gated(color.lab(np.stack([p[i : i + some] for p in planes], 1)[None])[..., 1:], c.gate_low, c.gate_high)[0]
            found += (*out.sum(0, dtype=np.int64), np.count_nonzero((out != 128).any(1)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if parts := list(page_parts([b])):
                found = np.array([sums(part) for part in parts])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([part.column("page_id").slice(0, 1) for part in parts]), *(pa.array(found[:, k]) for k in range(3))], ["page_id", *names])

    rows = colors.select("page_id", "b", "g", "r").mapInArrow(run, f"page_id {kind}, {', '.join(f'{n} long' for n in names)}")
    return rows.groupBy("page_id").agg(*[F.sum(n).alias(n) for n in names])
