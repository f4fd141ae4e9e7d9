"""Decisions about a page: the route, the order of flags, the confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.functions import clip, flags


def confidence(gate_flags: Column, boundary_missing: Column, geometry_uncertain: Column, approx_crop: Column, sane: Column) -> Column:
    """Penalties in the order of the stages, clipped to 0..1, three decimals.  Noise and moire cost nothing."""
    score = F.lit(1.0) - 0.15 * F.size(gate_flags)
    for hit, cost in ((boundary_missing, 0.25), (geometry_uncertain, 0.30), (approx_crop, 0.10), (~sane, 0.30)):
        score = F.when(hit, score - cost).otherwise(score)
    return F.bround(clip(score, 0.0, 1.0), 3)


def route(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """What becomes of a page after its outline is known.

    In: forced (corners that were given, or null), clean, quad (array or null), method (approx, rect, model), skip_warp,
    plausible.  An outline that no model found counts only where it is plausible; a model's that is not is kept, but
    the page is turned level and not warped by it.
    Adds: step (warp, deskew), margin, kept_quad, missing, unsure, approx, flat.
    """
    free = F.col("forced").isNull()
    model = F.coalesce(F.col("method") == "model", F.lit(False))
    quad = F.col("quad").isNotNull() & ~F.col("clean") & (model | F.coalesce(F.col("plausible"), F.lit(False)))
    flat = free & quad & F.col("skip_warp")
    shaped = free & quad & ~F.col("skip_warp")
    warped = ~free | (shaped & F.col("plausible"))
    margin = F.when(~free, 0.0).when(model, s.perspective.model_margin).otherwise(s.perspective.margin)
    return pages.withColumns({
        "step": F.when(warped, "warp").otherwise("deskew"),
        "margin": F.when(warped, margin),
        "kept_quad": F.when(free & quad, F.col("quad")),
        "missing": free & ~quad & ~F.col("clean"),
        "unsure": shaped & ~F.col("plausible"),
        "approx": shaped & F.col("plausible") & (F.col("method") == "rect"),
        "flat": flat,
    })


def decide(routed: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Flags in the order of the stages, and the confidence.

    In: what `route` adds, gate_flags, noise_sigma (rounded), routed (whether moire is treated), sanity_flags.
    """
    own = flags((F.col("missing"), "boundary_not_found"), (F.col("unsure"), "geometry_uncertain"), (F.col("approx"), "approx_crop"), (F.col("noise_sigma") >= s.adaptive.heavy, "noisy"), (F.col("routed"), "screen_moire"))
    every = F.concat("gate_flags", own, F.transform("sanity_flags", lambda f: F.concat(F.lit("sanity_"), f)))
    sure = confidence(F.col("gate_flags"), F.col("missing"), F.col("unsure"), F.col("approx"), F.size("sanity_flags") == 0)
    return routed.withColumns({"flags": every, "confidence": sure})
