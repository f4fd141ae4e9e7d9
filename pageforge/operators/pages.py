"""Stages of a page, raster in and raster or measures out.

Each stage runs numpy over one raster at a time inside Arrow batches; what is decided between stages is column
arithmetic (`geometry`, `score`, `stats.adaptive`).  No stage shuffles, so the stages of a page run in one task, and a
page of any size is one row.  Pages without pixels (null raster, no height or no width) go through: measures are those
of an empty page, rasters stay as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.functions import flags
from pageforge.kernels import color, filters, light, model, outline, stats, warp
from pageforge.operators import geometry, score
from pageforge.operators import stats as measures
from pageforge.operators.rasters import RASTER, packed, per_page, unpacked

POINTS = "array<struct<x:double,y:double>>"
CANDIDATES = f"array<struct<strategy:int,nth:int,area:double,rect_area:double,frame_area:double,method:string,pts:{POINTS}>>"


def timed(run: Callable[[np.ndarray, dict], dict], name: str) -> Callable[[np.ndarray, dict], dict]:
    """run, and how many milliseconds it took under a name."""

    def go(page, row):
        start = time.perf_counter()
        return run(page, row) | {name: (time.perf_counter() - start) * 1000}

    return go


def gate(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds sharpness, glare_hot_tiles, long_edge, gate_flags, passed.  Flags never block a page."""
    g = s.gate

    def run(page, _):
        gray = color.gray(page)
        return {"sharpness": stats.sharpness(gray, g.grid, g.content), "glare_hot_tiles": stats.hot_tiles(gray, g.grid, g.glare_value, g.glare_share), "long_edge": max(gray.shape)}

    out = per_page(pages, timed(run, "ms_gate"), "sharpness double, glare_hot_tiles int, long_edge int, ms_gate double")
    found = flags((F.col("sharpness") < g.sharp, "blur"), (F.col("glare_hot_tiles") > g.glare_tiles, "glare"), (F.col("long_edge") < s.ingest.low_edge, "low_resolution"))
    return out.withColumn("gate_flags", found).withColumn("passed", F.size("gate_flags") == 0)


def paper(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds clean_share, paper_share, already_clean, document_like."""
    c = s.light
    run = lambda page, _: {"clean_share": stats.share_of(page, c.clean_val, c.clean_sat), "paper_share": stats.share_of(page, c.paper_val, c.paper_sat)}
    out = per_page(pages, run, "clean_share double, paper_share double")
    return out.withColumns({"already_clean": F.col("clean_share") > c.clean_share, "document_like": F.col("paper_share") >= c.paper_share})


def measure(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds sigma (noise) and moire, for `stats.adaptive`."""
    run = lambda page, _: {"sigma": stats.noise(color.gray(page)), "moire": stats.moire(page, s.adaptive.grid)}
    return per_page(pages, run, "sigma double, moire double", empty={"sigma": 0.0, "moire": 0.0})


def found_outlines(page: np.ndarray, s: Settings) -> list[dict]:
    """Candidate outlines of both strategies, the largest of each, in full-size pixels; areas are those of the small copy."""
    h, w = page.shape[:2]
    scale = min(1.0, s.ingest.detect_edge / max(h, w))
    small = filters.resize(page, max(1, round(h * scale)), max(1, round(w * scale)), area=True) if scale < 1 else page
    frame = float(small.shape[0] * small.shape[1])
    gray = filters.bilateral(color.gray(small), 9, 60, 60)
    edges = outline.edge_mask(gray, *outline.thresholds(gray))
    bright = outline.paper_mask(color.saturation(small), color.value(small), s.boundary.paper_sat, s.boundary.paper_val)
    rows = []
    for strategy, (mask, holes) in enumerate(((edges, True), (bright, False))):
        borders = sorted(outline.contours(mask, s.boundary.min_area * frame, holes), key=lambda c: -c[1])[: s.boundary.top]
        for nth, (hull, area) in enumerate(borders):
            if len(hull) >= 3 and area >= s.boundary.min_area * frame:
                quad, method, rect = outline.fitted(hull)
                pts = [{"x": x, "y": y} for x, y in (quad / scale).tolist()]
                rows.append({"strategy": strategy, "nth": nth, "area": area / scale**2, "rect_area": rect / scale**2, "frame_area": float(h * w), "method": method, "pts": pts})
    return rows


def detect(pages: DataFrame, corners: Callable[[np.ndarray], np.ndarray | None] | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Adds h, w, clean, quad (ordered corners or null), method (approx, rect, model), coverage, skip_warp, plausible.

    Pages that are clean already, or whose column `forced` holds corners, are not searched.  `corners`, a model, is asked
    first where it is given; an outline of its own that is implausible counts as none.
    """
    c = s.light
    forced = "forced" in pages.columns

    def run(page, row):
        h, w = page.shape[:2]
        clean = stats.share_of(page, c.clean_val, c.clean_sat) > c.clean_share
        out = {"h": h, "w": w, "clean": clean, "candidates": []}
        if not clean and row.get("forced") is None:
            spots = corners(page) if corners else None
            if spots is not None:
                out["model"] = [{"x": float(x), "y": float(y)} for x, y in spots]
            else:
                out["candidates"] = found_outlines(page, s)
        return out

    adds = f"h int, w int, clean boolean, candidates {CANDIDATES}, model {POINTS}, ms_boundary double"
    out = per_page(pages, timed(run, "ms_boundary"), adds, ("forced",) if forced else (), {"h": 0, "w": 0, "clean": False, "candidates": []})
    sound = geometry.model_plausible(F.col("model"), F.col("w"), F.col("h"), s)
    best = geometry.best_of(F.col("candidates"), s)
    out = out.withColumn("best", F.when(F.col("model").isNotNull() & sound, F.struct(F.lit("model").alias("method"), F.col("model").alias("pts"))).otherwise(F.struct(best["method"].alias("method"), best["pts"].alias("pts"))))
    out = out.withColumns({"pts": F.col("best.pts"), "method": F.col("best.method")}).drop("best", "model", "candidates")
    return geometry.judged(out, s).withColumn("quad", F.col("rect")).drop("rect", "pts")


def rectify(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Warps (or turns level) each raster as `score.route` says; adds noise_sigma, moire_score, denoise, sharpen, route_demoire, document_like.

    In: raster, step, crop (ordered corners in pixels where step is warp), out_w, out_h.
    """
    a, c = s.adaptive, s.light

    def run(page, row):
        if row["step"] == "warp":
            rect = np.array([[p["x"], p["y"]] for p in row["crop"]])
            page = warp.warp(page, rect, row["out_w"], row["out_h"])
        else:
            page = warp.deskewed(page, color.gray(page))
        return {"raster": packed(page)}

    def measure(page, _):
        return {"sigma": stats.noise(color.gray(page)), "moire": stats.moire(page, a.grid), "document_like": stats.share_of(page, c.paper_val, c.paper_sat) >= c.paper_share}

    def both(page, row):
        out = timed(run, "ms_perspective")(page, row)
        return out | measure(unpacked(out["raster"]), row)

    adds = f"{RASTER}, sigma double, moire double, document_like boolean, ms_perspective double"
    out = per_page(pages, both, adds, ("step", "crop", "out_w", "out_h"), {"sigma": 0.0, "moire": 0.0, "document_like": False})
    return out.withColumns(measures.adaptive_columns(s)).drop("sigma", "moire")


def enhance(pages: DataFrame, demoire: Callable[[np.ndarray], np.ndarray] | None = None, s: Settings = SETTINGS) -> DataFrame:
    """The finished raster of each warped page; adds aspect, uniform_frac, sanity_flags and mode_error.

    In: raster, denoise, sharpen, document_like, routed, output_mode.  `demoire` takes a page and gives a page, as
    `moire_model` does.  A page whose mode is unknown comes in colour, and mode_error says so.
    """
    c, a = s.light, s.adaptive

    def run(page, row):
        out, took = {}, time.perf_counter()

        def lap(name):
            nonlocal took
            now = time.perf_counter()
            out[name], took = (now - took) * 1000, now

        if row["routed"] and demoire:
            page = demoire(page)
            lap("ms_demoire")
        page = light.flattened(page, row["document_like"], c, c.moire_white if row["routed"] else None)
        lap("ms_illumination")
        page = light.denoised(page, row["denoise"]["mode"], row["denoise"]["sigma_color"])
        page = light.sharpened(page, a.rerun_amount if row["routed"] else row["sharpen"]["amount"], row["sharpen"]["radius"])
        lap("ms_denoise")
        mode = row["output_mode"] or "color"
        known = mode in light.MODES
        page = light.in_mode(page, mode if known else "color")
        lap("ms_output")
        return out | {"raster": packed(page), "mode_error": None if known else f"unknown output mode {mode}"} | checked(page)

    adds = f"{RASTER}, aspect double, wide double, uniform_frac double, ms_demoire double, ms_illumination double, ms_denoise double, ms_output double, mode_error string"
    out = per_page(pages, run, adds, ("denoise", "sharpen", "document_like", "routed", "output_mode"), EMPTY)
    return out.withColumn("sanity_flags", sanity_flags(s)).drop("wide")


EMPTY = {"aspect": 0.0, "wide": 0.0, "uniform_frac": 1.0}


def checked(page: np.ndarray) -> dict:
    h, w = page.shape[:2]
    return {"aspect": max(h, w) / min(h, w), "wide": w / h, "uniform_frac": stats.uniform_share(page)}


def sanity_flags(s: Settings = SETTINGS) -> Column:
    """Of the columns wide (0 for an empty page) and uniform_frac."""
    c, wide = s.sanity, F.col("wide")
    odd = ~wide.between(c.min_aspect, c.max_aspect) & ~(1.0 / wide).between(c.min_aspect, c.max_aspect)
    return F.when(wide == 0, F.array(F.lit("empty"))).otherwise(flags((odd, "implausible_aspect"), (F.col("uniform_frac") > c.uniform, "mostly_uniform")))


def sanity(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds aspect, uniform_frac, flags, passed; pages without pixels fail as empty."""
    out = per_page(pages, lambda page, _: checked(page), "aspect double, wide double, uniform_frac double", empty=EMPTY)
    return out.withColumn("flags", sanity_flags(s)).drop("wide").withColumn("passed", F.size("flags") == 0)


def process(pages: DataFrame, corners: Callable | None = None, demoire: Callable | None = None, s: Settings = SETTINGS) -> DataFrame:
    """The whole way of each page: raster cleaned, quad (normalized corners), flags, confidence, routed, timings_ms, mode_error.

    In: page_id, raster and, where given, forced (four normalized corners as array<struct<x,y>>), demoire (boolean, the
    user's wish) and output_mode (color, gray, bw).  Other columns stay.  `corners` and `demoire` are models.
    """
    for name, kind in (("forced", POINTS), ("demoire", "boolean"), ("output_mode", "string")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    out = score.route(detect(gate(pages, s), corners, s), s)
    own = geometry.ordered(F.when(F.col("forced").isNotNull(), geometry.scaled(F.col("forced"), F.col("w"), F.col("h"))).otherwise(F.col("quad")))
    out = out.withColumn("crop", F.when(F.col("step") == "warp", geometry.expand(own, F.col("margin"), F.col("w"), F.col("h"))))
    out = out.withColumns({"out_w": geometry.warp_size(F.col("crop"))["w"], "out_h": geometry.warp_size(F.col("crop"))["h"]})
    kept = F.when(F.col("step") == "warp", F.col("crop")).otherwise(F.col("kept_quad"))
    kept = F.when(F.col("forced").isNotNull(), F.col("forced")).otherwise(geometry.normalized(kept, F.col("w"), F.col("h")))
    out = out.withColumn("kept_quad", kept)
    out = rectify(out, s).withColumn("routed", F.coalesce(F.col("demoire"), F.col("route_demoire")))
    out = score.decide(enhance(out, demoire, s), s)
    stages = {"gate": F.col("ms_gate"), "boundary_perspective": F.col("ms_boundary") + F.col("ms_perspective"), **{n: F.col(f"ms_{n}") for n in ("demoire", "illumination", "denoise", "output")}}
    timings = F.map_filter(F.create_map(*[x for n, c in stages.items() for x in (F.lit(n), F.bround(c, 1))]), lambda _, v: v.isNotNull())
    gone = ("h", "w", "clean", "quad", "method", "coverage", "skew", "skip_warp", "plausible", "crop", "out_w", "out_h", "step", "margin", "missing", "unsure", "approx", "flat", "passed", "forced", "demoire", "route_demoire")
    out = out.withColumn("timings_ms", timings).drop(*gone, *[c for c in out.columns if c.startswith("ms_")])
    return out.withColumnRenamed("kept_quad", "quad").withColumn("mode", F.coalesce("output_mode", F.lit("color"))).drop("output_mode")


def reprocess(edited: DataFrame, s: Settings = SETTINGS, **models: Callable) -> DataFrame:
    """Pages as their edits want them, from the original rasters: warped by the corners, in the mode, then turned.

    In: raster (the original) and, as `catalog.page_state` folds them, corners (normalized), mode, demoire, rotation.
    """
    forced = F.transform("corners", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    done = process(edited.withColumn("forced", forced).withColumnRenamed("mode", "output_mode").drop("corners"), s=s, **models)
    return rotated(done, F.coalesce("rotation", F.lit(0)))


def rotated(pages: DataFrame, degrees: Column) -> DataFrame:
    """Rasters turned clockwise by multiples of 90 degrees."""
    run = lambda page, row: {"raster": packed(warp.quarter_turns(page, row["degrees"]))}
    return per_page(pages.withColumn("degrees", degrees), run, RASTER, ("degrees",)).drop("degrees")


def corner_model(run: Callable[[np.ndarray], np.ndarray], pad: float = 0.30) -> Callable[[np.ndarray], np.ndarray | None]:
    """A detector for `detect` from a model that takes [1, 3, 256, 256] and gives [1, 4, h, w]; it never raises."""

    def corners(page):
        x, border = model.corner_input(page, pad)
        try:
            heat = run(x)
        except Exception:  # a model that fails counts as one that finds nothing
            heat = None
        if heat is None:
            return None
        return model.corners_of(np.asarray(heat)[0], *page.shape[:2], border)

    return corners


def moire_model(run: Callable[[np.ndarray], np.ndarray | None], most: int = model.MOST) -> Callable[[np.ndarray], np.ndarray]:
    """What `enhance` calls, from a model that takes and gives [1, 3, h, w] of 0 to 1: the page made small, bordered to
    whole steps, and back.  Pages stay as they are where the model fails or gives nothing."""

    def clean(page):
        try:
            return model.without_moire(page, run, most)
        except Exception:
            return page

    return clean
