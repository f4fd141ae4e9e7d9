"""Outlines of pages: four corners as array<struct<x,y>>, all arithmetic within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.functions import clip, let


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _mean(pts: Column, k: str) -> Column:
    return F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[k]) / F.size(pts)


def ordered(pts: Column) -> Column:
    """Corners by angle about their mean, from the one nearest the origin (least x + y)."""
    angle = lambda p: F.atan2(p["y"] - _mean(pts, "y"), p["x"] - _mean(pts, "x"))
    ring = F.array_sort(F.transform(pts, lambda p, i: F.struct(angle(p).alias("a"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    ring = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sums = F.transform(ring, lambda p: p["x"] + p["y"])
    start = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(ring, start, F.size(ring)), F.slice(ring, F.lit(1), start - 1))


def _next(pts: Column, i: Column, step: int = 1) -> Column:
    return F.get(pts, F.pmod(i + step, F.size(pts)))


def area(pts: Column) -> Column:
    cross = F.transform(pts, lambda p, i: p["x"] * _next(pts, i)["y"] - _next(pts, i)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def skew(pts: Column) -> Column:
    """The greatest turn of an edge from the nearest axis, in degrees."""
    turn = F.transform(pts, lambda p, i: F.pmod(F.degrees(F.atan2(_next(pts, i)["y"] - p["y"], _next(pts, i)["x"] - p["x"])), F.lit(90.0)))
    return F.array_max(F.transform(turn, lambda a: F.least(a, 90.0 - a)))


def angles(pts: Column) -> Column:
    """Interior angles in degrees."""

    def at(p: Column, i: Column) -> Column:
        a, b = _next(pts, i, -1), _next(pts, i)
        dot = (a["x"] - p["x"]) * (b["x"] - p["x"]) + (a["y"] - p["y"]) * (b["y"] - p["y"])
        return F.degrees(F.acos(clip(dot / (distance(a, p) * distance(b, p) + 1e-6), -1.0, 1.0)))

    return F.transform(pts, at)


def side_ratios(pts: Column) -> Column:
    """The larger over the smaller of each pair of opposite sides."""
    side = [distance(F.get(pts, F.lit(i)), F.get(pts, F.lit((i + 1) % 4))) for i in range(4)]
    return F.array(*[F.greatest(side[i], side[i + 2]) / (F.least(side[i], side[i + 2]) + 1e-6) for i in (0, 1)])


def convex(pts: Column) -> Column:
    """Whether the corners, cut to integers, turn one way only."""
    whole = F.transform(pts, lambda p: F.struct(p["x"].cast("int").cast("double").alias("x"), p["y"].cast("int").cast("double").alias("y")))

    def turn(p: Column, i: Column) -> Column:
        a, b = _next(whole, i), _next(whole, i, 2)
        return (a["x"] - p["x"]) * (b["y"] - a["y"]) - (a["y"] - p["y"]) * (b["x"] - a["x"])

    turns = F.transform(whole, turn)
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)


def expand(pts: Column, share: Column, w: Column, h: Column) -> Column:
    """Corners pushed out from their mean by a share of their distance, within the page."""
    def push(p: Column) -> Column:
        far = lambda k: _mean(pts, k) + (p[k] - _mean(pts, k)) * (1.0 + share)
        return F.struct(F.greatest(F.lit(0.0), F.least(w - 1.0, far("x"))).alias("x"), F.greatest(F.lit(0.0), F.least(h - 1.0, far("y"))).alias("y"))

    return F.when(share > 0, F.transform(pts, push)).otherwise(pts)


def scaled(pts: Column, x: Column, y: Column) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] * x).alias("x"), (p["y"] * y).alias("y")))


def normalized(pts: Column, w: Column, h: Column) -> Column:
    return scaled(pts, 1.0 / w, 1.0 / h)


def warp_size(pts: Column) -> Column:
    """Width and height of the corrected page: the longer of each pair of sides, rounded half to even, at least 1."""
    side = [distance(F.get(pts, F.lit(i)), F.get(pts, F.lit((i + 1) % 4))) for i in range(4)]
    size = lambda a, b: F.greatest(F.lit(1), F.bround(F.greatest(a, b), 0).cast("int"))
    return F.struct(size(side[0], side[2]).alias("w"), size(side[1], side[3]).alias("h"))


def judged(quads: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """page_id, rect, coverage, skew, skip_warp, plausible of outlines (page_id, w, h, pts)."""
    p = s.perspective
    q = quads.withColumn("rect", ordered(F.col("pts")))
    q = q.withColumns({"coverage": area(F.col("rect")) / (F.col("w") * F.col("h")), "skew": skew(F.col("rect"))})
    fair = F.forall(angles(F.col("rect")), lambda a: a.between(p.min_angle, p.max_angle)) & F.forall(side_ratios(F.col("rect")), lambda r: r <= p.max_ratio)
    return q.withColumns({"skip_warp": (F.col("coverage") >= p.flat_cover) & (F.col("skew") < p.flat_skew), "plausible": fair})


def model_plausible(pts: Column, w: Column, h: Column, s: Settings = SETTINGS) -> Column:
    """Whether a model's corners cover a fair share of the page and none lies within the others' triangle."""

    def fair(rect: Column) -> Column:
        def turn(p: Column, i: Column) -> Column:
            a, b = _next(rect, i), _next(rect, i, 2)
            return (a["x"] - p["x"]) * (b["y"] - a["y"]) - (a["y"] - p["y"]) * (b["x"] - a["x"])

        return (area(rect) / (w * h)).between(s.boundary.min_area, s.boundary.max_cover) & F.forall(F.transform(rect, turn), lambda t: t > 0)

    return let(ordered(pts), fair)


def score(c: Column, s: Settings = SETTINGS) -> Column:
    """A candidate's score: the share it covers, less where it fills its least rectangle badly or is that rectangle."""
    full = F.when(c["rect_area"] > 0, c["area"] / c["rect_area"]).otherwise(0.0)
    return area(c["pts"]) / c["frame_area"] * (0.5 + 0.5 * full) * F.when(c["method"] == "approx", 1.0).otherwise(s.boundary.rect_factor)


def best_of(candidates: Column, s: Settings = SETTINGS) -> Column:
    """The best outline in an array of them, null without one; ties go to the first strategy and contour."""
    b = s.boundary
    fair = lambda c: (c["area"] >= b.min_area * c["frame_area"]) & (area(c["pts"]) / c["frame_area"]).between(b.min_area, b.max_cover) & convex(c["pts"])
    ranked = F.transform(F.filter(candidates, fair), lambda c: F.struct(score(c, s).alias("score"), (-c["strategy"]).alias("s"), (-c["nth"]).alias("n"), c["method"].alias("method"), c["pts"].alias("pts")))
    return F.array_max(ranked)


def choose(candidates: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The best outline of each page from contours (page_id, strategy, nth, area, rect_area, frame_area, method, pts).

    Each strategy's largest contours come first, and only then those that are too small, too large or not convex go;
    the best score wins, ties go to the first strategy and contour.
    """
    b = s.boundary
    first = F.row_number().over(Window.partitionBy("page_id", "strategy").orderBy(F.desc("area"), "nth"))
    c = candidates.withColumn("place", first).where(F.col("place") <= b.top).withColumn("coverage", area(F.col("pts")) / F.col("frame_area"))
    c = c.where((F.col("area") >= b.min_area * F.col("frame_area")) & F.col("coverage").between(b.min_area, b.max_cover) & convex(F.col("pts")))
    c = c.withColumn("score", score(F.struct("area", "rect_area", "frame_area", "method", "pts"), s))
    best = F.max_by(F.struct("strategy", "nth", "method", "score", "pts"), F.struct(F.col("score"), -F.col("strategy"), -F.col("place")))
    return c.groupBy("page_id").agg(best.alias("c")).select("page_id", "c.*")


def detection_scale(h: Column, w: Column, s: Settings = SETTINGS) -> Column:
    return F.least(F.lit(1.0), s.ingest.detect_edge / F.greatest(h, w))


def median_turn(lines: DataFrame, by: list[str], degrees: str = "degrees") -> DataFrame:
    """The exact median of near-horizontal lines' turns, as `turn`; groups without such lines have none."""
    return lines.where((F.col(degrees) > -45) & (F.col(degrees) < 45)).groupBy(*by).agg(F.percentile(degrees, 0.5).alias("turn"))
