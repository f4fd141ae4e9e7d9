"""All queries of the page engine by name, and the SQL that checks them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.config import SETTINGS
from pageforge.kernels import color, filters, light, model, outline, warp
from pageforge.operators import assembly, catalog, contrast, geometry, integral, lines, pages, regions, score, snapshots, stats, tiles, uploads
from pageforge.plans.oracles import ORACLES
from pageforge.session import shared_dir
from pageforge.sources import fixtures, models
from pageforge.streaming import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query
def gate_tiles(spark, sf_dir):
    """Sharpness and glare by tiles, flags, confidence: the flagship."""
    g = pages.gate(fixtures.rasters64(spark, sf_dir))
    no = F.lit(False)
    conf = score.confidence(F.col("gate_flags"), no, no, no, F.lit(True))
    return g.select("page_id", r("sharpness"), "glare_hot_tiles", "long_edge", F.array_join("gate_flags", ",").alias("flags"), "passed", conf.alias("confidence"))


@query
def gate_lines(spark, sf_dir):
    """The same measures over scan lines that stream through a task in order, instead of whole pages."""
    g = stats.gate(fixtures.gray64(spark, sf_dir))
    return g.select("page_id", r("sharpness"), "glare_hot_tiles", "long_edge", F.array_join("flags", ",").alias("flags"), "passed")


@query
def noise_sigma(spark, sf_dir):
    return stats.noise_sigma(fixtures.gray8(spark, sf_dir)).select("page_id", r("sigma"))


@query
def page_noise(spark, sf_dir):
    """The same measure as the stages of a page take it."""
    return pages.measure(fixtures.rasters8(spark, sf_dir)).select("page_id", r("sigma"))


@query
def adaptive_params(spark, sf_dir):
    noise = stats.noise_sigma(fixtures.gray8(spark, sf_dir, noisy=True))
    found = stats.adaptive(noise.join(pages.measure(fixtures.rasters64(spark, sf_dir, color=True)).select("page_id", "moire"), "page_id"))
    return found.select("page_id", r("noise_sigma", 1), F.col("denoise.mode").alias("denoise"), F.col("denoise.sigma_color").alias("sigma_color"), F.col("sharpen.amount").alias("amount"), F.col("sharpen.radius").alias("radius"), "route_demoire")


@query
def moire_score(spark, sf_dir):
    return pages.measure(fixtures.rasters64(spark, sf_dir, color=True)).select("page_id", r("moire", 5))


@query
def paper_fraction(spark, sf_dir):
    return pages.paper(fixtures.rasters64(spark, sf_dir, color=True)).select("page_id", r("clean_share"), r("paper_share"), "already_clean", "document_like")


@query
def page_sanity(spark, sf_dir):
    blank = F.when(F.col("page_id") % 50 == 7, F.struct(F.lit(0).alias("height"), F.lit(64).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.lit(b"").alias("data"))).otherwise(F.col("raster"))
    found = pages.sanity(fixtures.rasters64(spark, sf_dir, color=True).withColumn("raster", blank))
    return found.select("page_id", r("aspect"), r("uniform_frac"), F.array_join("flags", ",").alias("flags"), "passed")


@query
def level_percentiles(spark, sf_dir):
    low, high, *_ = SETTINGS.light.document
    return stats.levels(fixtures.gray8(spark, sf_dir), low, high).select("page_id", r("lo"), r("hi"))


@query
def level_stretch(spark, sf_dir):
    """Stretched pages, as the sum of their pixels weighted by place."""
    low, high, floor, gamma, _ = SETTINGS.light.document

    def run(page, _):
        out = light.stretched(page[..., 0], low, high, floor, gamma).astype(np.int64)
        return {"weighted_sum": int((out * np.outer(np.arange(1, len(out) + 1), np.arange(1, out.shape[1] + 1))).sum()), "top": int(out.max()), "bottom": int(out.min())}

    return pages.per_page(fixtures.rasters64(spark, sf_dir), run, "weighted_sum long, top int, bottom int").drop("raster")


@query
def edge_thresholds(spark, sf_dir):
    return stats.edge_thresholds(fixtures.gray64(spark, sf_dir))


@query
def page_thresholds(spark, sf_dir):
    """The same thresholds, without the median, as the search for outlines takes them."""
    run = lambda page, _: dict(zip(("low", "high"), outline.thresholds(page[..., 0])))
    return pages.per_page(fixtures.rasters64(spark, sf_dir), run, "low int, high int").drop("raster")


@query
def clean_pages(spark, sf_dir):
    """The whole way of small colour pages; its stages have queries of their own with SQL, the whole has tests."""
    done = pages.process(fixtures.rasters64(spark, sf_dir, color=True))
    return done.select("page_id", F.col("raster.height").alias("height"), F.col("raster.width").alias("width"), F.array_join("flags", ",").alias("flags"), "confidence", "noise_sigma", "moire_score", "routed")


@query
def black_white(spark, sf_dir):
    """Pages of 64 by 64 in black and white: white pixels, and their sum weighted by place."""

    def run(page, _):
        white = light.in_mode(page, "bw")[..., 0].astype(np.int64) // 255
        return {"white": int(white.sum()), "weighted_sum": int((white * np.outer(np.arange(1, len(white) + 1), np.arange(1, white.shape[1] + 1))).sum())}

    return pages.per_page(fixtures.rasters64(spark, sf_dir), run, "white long, weighted_sum long").drop("raster")


@query
def sauvola_lines(spark, sf_dir):
    """Pages of 8 by 8 in black and white from scan lines, by running sums in both directions; windows reach beyond all borders."""
    white = integral.black_white(fixtures.gray8(spark, sf_dir))
    place = F.when(F.col("white"), (F.col("y") + 1) * (F.col("x") + 1))
    return white.groupBy("page_id").agg(F.count_if("white").alias("white"), F.coalesce(F.sum(place), F.lit(0)).cast("long").alias("weighted_sum"))


@query
def contrast_lines(spark, sf_dir):
    """Pages of 64 by 64 with their contrast equalized as documents', added up by place."""
    lines = contrast.equalized(fixtures.gray64(spark, sf_dir), SETTINGS.light.document[4])
    pixels = lines.select("page_id", "y", F.posexplode("v").alias("x", "v"))
    return pixels.groupBy("page_id").agg(F.sum(F.col("v").cast("long") * (F.col("x") + 1) * (F.col("y") + 1)).alias("weighted_sum"))


@query
def background_close(spark, sf_dir):
    """Marks closed on pages of 8 by 8 by a disc of 3 by 3 (a cross), added up by place."""

    def run(page, _):
        out = filters.close_ellipse(page[..., 0], 3).astype(np.int64)
        return {"weighted_sum": int((out * np.outer(np.arange(1, 9), np.arange(1, 9))).sum())}

    return pages.per_page(fixtures.rasters8(spark, sf_dir), run, "weighted_sum long").drop("raster")


@query
def corner_heat(spark, sf_dir):
    """Centres of the largest hot region in heat of 8 by 8 for each vector."""

    def run(page, _):
        spot = outline.blob_center(page[..., 0], 160)
        return {"x": spot[0], "y": spot[1]} if spot else {}

    return pages.per_page(fixtures.rasters8(spark, sf_dir), run, "x double, y double").select("page_id", r("x"), r("y"))


@query
def mask_regions(spark, sf_dir):
    """First pixel, area, box and centre of every connected region of bright spots on pages of 64 by 64."""
    bright = 28 * F.col("label") + 11 + F.col("page_id") % 8
    rows = fixtures.gray64(spark, sf_dir)
    found = regions.regions(regions.labelled(regions.runs(rows, F.transform("v", lambda v: v > bright))))
    return found.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query
def hough_turns(spark, sf_dir):
    """The turn of pages on which lines of one slope are drawn, by their votes."""
    return lines.turns(lines.lines(fixtures.strokes(spark, sf_dir), least=30))


@query
def tile_gaussian(spark, sf_dir):
    """Pages of 64 by 64, cut into tiles of 24, blurred as for sharpening; their pixels added up by place."""
    cells = tiles.tiled(fixtures.rasters64(spark, sf_dir), 24)
    return tiles.weighted(tiles.stencil(cells, 3, lambda page: filters.gaussian(page[..., 0], 0.8), 24))


@query
def tile_warp(spark, sf_dir):
    """Outlines of pages of 64 by 64 as upright pages, from tiles of 24 that output tiles ask for; pixels added up by place."""
    shrink = lambda k: F.transform(geometry.ordered(F.col("pts")), lambda p: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y")))
    corners = fixtures.quads(spark, sf_dir).select("page_id", F.lit(64).alias("h"), F.lit(64).alias("w"), shrink(0.064).alias("rect"))
    corners = corners.withColumn("size", geometry.warp_size(F.col("rect"))).select("page_id", "h", "w", "rect", F.col("size.w").alias("out_w"), F.col("size.h").alias("out_h"))
    return tiles.weighted(tiles.warped(tiles.tiled(fixtures.rasters64(spark, sf_dir), 24), corners, 24))


@query
def model_corners(spark, sf_dir):
    """Whether corners are what a model may give: those of the outlines, every fifth page with one corner drawn inwards."""
    q = fixtures.quads(spark, sf_dir).withColumn("rect", geometry.ordered(F.col("pts")))
    inner = F.struct(F.lit(420.0).alias("x"), F.lit(430.0).alias("y"))
    pts = F.transform("rect", lambda p, i: F.when((F.col("page_id") % 5 == 0) & (i == 2), inner).otherwise(p))
    return q.select("page_id", geometry.model_plausible(pts, F.col("w"), F.col("h")).alias("plausible"))


@query
def warp_coordinates(spark, sf_dir):
    """Where the middle of each warped page comes from: the crossing of its diagonals."""

    def points(batches):
        for b in batches:
            rows = []
            for pts, size in zip(b.column("rect").to_pylist(), b.column("size").to_pylist()):
                w, h = size["w"], size["h"]
                m = warp.homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float), np.array([[p["x"], p["y"]] for p in pts]))
                x, y, z = m @ ((w - 1) / 2, (h - 1) / 2, 1)
                rows.append((x / z, y / z))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([p[k] for p in rows], pa.float64()) for k in (0, 1))], ["page_id", "x", "y"])

    q = fixtures.quads(spark, sf_dir).withColumn("rect", geometry.ordered(F.col("pts"))).withColumn("size", geometry.warp_size(F.col("rect")))
    q = q.select("page_id", "rect", "size").mapInArrow(points, "page_id long, x double, y double")
    return q.select("page_id", r("x", 4), r("y", 4))


@query
def moire_borders(spark, sf_dir):
    """Pixels before and after that bring sizes to whole steps of the moire model."""

    def run(batches):
        for b in batches:
            both = [model.border_to(n) for n in b.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), *(pa.array([x[k] for x in both], pa.int32()) for k in (0, 1))], ["p_partkey", "before", "after"])

    sizes = fixtures.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10 + F.col("p_partkey") % 7).alias("size"))
    return sizes.mapInArrow(run, "p_partkey long, before int, after int")


@query
def moire_stage(spark, sf_dir):
    """Pages through the moire stage with a model that halves light: bordered, taken back, pixels added up."""
    halve = pages.moire_model(lambda x: x * np.float32(0.5))
    run = lambda page, _: {"weighted_sum": int((halve(page)[..., 0].astype(np.int64) * np.outer(np.arange(1, len(page) + 1), np.arange(1, page.shape[1] + 1))).sum())}
    return pages.per_page(fixtures.rasters64(spark, sf_dir), run, "weighted_sum long").drop("raster")


@query
def shipped_model(spark, sf_dir):
    """Centres of the largest hot region by a model that comes as a file, and by one whose file cannot be read as one."""
    folder = Path(tempfile.mkdtemp(prefix="models-"))  # on the driver alone; Spark ships the files
    np.save(folder / "heat.npy", np.array([160]))
    (folder / "broken.npy").write_bytes(b"no model")

    def load(path):
        (least,) = np.load(path)
        return lambda plane: outline.blob_center(plane, int(least))

    good, bad = (models.Shipped(spark, str(folder / f"{n}.npy"), load) for n in ("heat", "broken"))

    def run(page, _):
        spot, none = good(page[..., 0]), bad(page[..., 0])
        return {"x": spot[0] if spot else None, "y": spot[1] if spot else None, "broken": none is not None}

    return pages.per_page(fixtures.rasters8(spark, sf_dir), run, "x double, y double, broken boolean").select("page_id", r("x"), r("y"), "broken")


@query
def export_audit(spark, sf_dir):
    """The audit event of an export of all conversations: sessions and pages, counted while they are written."""
    where = shared_dir(spark)
    live = fixtures.turns(spark, sf_dir).where("not deleted").groupBy("session_id").agg(F.count("*").alias("pages"))
    rows, seen = catalog.counted(live, sessions=F.count("*"), pages=F.sum("pages"))
    rows.write.parquet(f"{where}/exports")
    catalog.record(spark, f"{where}/events", "system", "scan.export", "conversations", seen)
    found = catalog.events(spark, f"{where}/events")
    return found.select("action", "target", *[F.col("detail")[n].cast("long").alias(n) for n in ("sessions", "pages")])


@query
def chroma_gate(spark, sf_dir):
    """Chroma of each page after the gate, added up; whether any colour is left."""
    c = SETTINGS.light

    def run(page, _):
        out = light.gated(color.lab(page)[..., 1:], c.gate_low, c.gate_high).astype(np.int64)
        return {"sum_a": int(out[..., 0].sum()), "sum_b": int(out[..., 1].sum()), "colored": int((out != 128).any(2).sum())}

    return pages.per_page(fixtures.rasters64(spark, sf_dir, color=True), run, "sum_a long, sum_b long, colored long").drop("raster")


@query
def chroma_lines(spark, sf_dir):
    """The same over scan lines, whatever part of a page comes at a time."""
    return stats.chroma(fixtures.color64(spark, sf_dir))


@query
def page_grays(spark, sf_dir):
    """Gray, saturation and value of colour pages, added up."""

    def run(page, _):
        return {"gray": int(color.gray(page).sum(dtype=np.int64)), "saturation": int(color.saturation(page).sum(dtype=np.int64)), "value": int(color.value(page).sum(dtype=np.int64))}

    return pages.per_page(fixtures.rasters64(spark, sf_dir, color=True), run, "gray long, saturation long, value long").drop("raster")


@query
def rotate_pages(spark, sf_dir):
    """Quarter turns clockwise of gray pages, as sums weighted by place; every page by its id modulo 4 turns."""
    turned = pages.rotated(fixtures.rasters8(spark, sf_dir), (90 * (F.col("page_id") % 4)).cast("int"))
    run = lambda page, _: {"weighted_sum": int((page[..., 0].astype(np.int64).ravel() * np.arange(1, 65)).sum())}
    return pages.per_page(turned, run, "weighted_sum long").drop("raster")


@query
def quad_geometry(spark, sf_dir):
    j = geometry.judged(fixtures.quads(spark, sf_dir))
    top = F.col("rect")[0]
    return j.select("page_id", F.round(top["x"], 6).alias("tl_x"), F.round(top["y"], 6).alias("tl_y"), r("coverage"), r("skew"), "skip_warp", "plausible", geometry.convex(F.col("rect")).alias("convex"))


@query
def quad_expand(spark, sf_dir):
    q = fixtures.quads(spark, sf_dir).withColumn("rect", geometry.ordered(F.col("pts")))
    q = q.withColumn("out", geometry.normalized(geometry.expand(F.col("rect"), F.lit(SETTINGS.perspective.margin), F.col("w"), F.col("h")), F.col("w"), F.col("h")))
    q = q.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = F.get("out", F.col("corner"))
    return q.select("page_id", "corner", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query
def warp_dims(spark, sf_dir):
    q = fixtures.quads(spark, sf_dir).withColumn("size", geometry.warp_size(geometry.ordered(F.col("pts"))))
    return q.select("page_id", F.col("size.w").alias("out_w"), F.col("size.h").alias("out_h"))


@query
def detection_scale(spark, sf_dir):
    """The factor by which pages of the order lines' sizes shrink for detection."""
    rows = fixtures.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).cast("int").alias("h"), (F.col("p_partkey") % 4000 + 1).cast("int").alias("w"))
    return rows.select("p_partkey", F.round(geometry.detection_scale(F.col("h"), F.col("w")), 9).alias("scale"))


def candidates(spark, sf_dir):
    """Contours of each page, made from the outlines of pages with the same label."""
    q = fixtures.quads(spark, sf_dir).withColumn("rect", geometry.ordered(F.col("pts")))
    made = F.explode(F.sequence(F.lit(0), F.lit(11)))
    c = q.withColumn("k", made).withColumn("shrink", 1.0 - 0.06 * ((F.col("k") * 5 + F.col("page_id")) % 12))
    return c.select(
        "page_id",
        (F.col("k") % 2).alias("strategy"),
        F.floor(F.col("k") / 2).cast("int").alias("nth"),
        (geometry.area(F.col("rect")) * F.col("shrink") * F.col("shrink")).alias("area"),
        (geometry.area(F.col("rect")) * F.col("shrink") * F.col("shrink") * (1.0 + (F.col("k") % 3) / 10.0)).alias("rect_area"),
        (F.col("w") * F.col("h")).cast("double").alias("frame_area"),
        F.when(F.col("k") % 3 == 0, "rect").otherwise("approx").alias("method"),
        geometry.scaled(F.col("rect"), F.col("shrink"), F.col("shrink")).alias("pts"),
    )


@query
def quad_choice(spark, sf_dir):
    """The best of each page's candidate outlines."""
    return geometry.choose(candidates(spark, sf_dir)).select("page_id", "strategy", "nth", "method", r("score"))


@query
def quad_best(spark, sf_dir):
    """The same choice among candidates in an array, as the stages of a page make it."""
    c = candidates(spark, sf_dir)
    first = F.struct((-F.col("area")).alias("a"), "nth", F.struct(*[F.col(n) for n in c.columns[1:]]).alias("c"))
    c = c.groupBy("page_id", "strategy").agg(F.slice(F.array_sort(F.collect_list(first)), 1, SETTINGS.boundary.top).alias("top"))
    c = c.select("page_id", F.transform("top", lambda x, i: x["c"].withField("nth", i)).alias("top"), F.transform("top", lambda x: x["nth"]).alias("names"), "strategy")
    c = c.groupBy("page_id").agg(F.flatten(F.array_sort(F.collect_list("top"))).alias("all"), F.map_from_entries(F.collect_list(F.struct("strategy", "names"))).alias("names"))
    best = geometry.best_of(F.col("all"))
    out = c.select("page_id", "names", best.alias("b")).where("b is not null").withColumn("strategy", -F.col("b.s"))
    return out.select("page_id", "strategy", F.get(F.element_at("names", F.col("strategy")), -F.col("b.n")).alias("nth"), F.col("b.method").alias("method"), F.round("b.score", 6).alias("score"))


@query
def page_decisions(spark, sf_dir):
    """The decision tree over measured outlines and noise, every path of it."""
    q = geometry.judged(fixtures.quads(spark, sf_dir)).join(stats.noise_sigma(fixtures.gray8(spark, sf_dir, noisy=True)), "page_id")
    i = F.col("page_id")
    q = q.select(
        "page_id",
        F.when(i % 3 == 0, F.array(F.lit("blur"))).when(i % 7 == 0, F.array(F.lit("blur"), F.lit("glare"))).otherwise(F.array().cast("array<string>")).alias("gate_flags"),
        F.when(i % 11 == 0, F.col("rect")).alias("forced"),
        (i % 5 == 0).alias("clean"),
        F.when(i % 4 != 0, F.col("rect")).alias("quad"),
        F.when(i % 3 == 1, "rect").when(i % 3 == 2, "model").otherwise("approx").alias("method"),
        "skip_warp",
        "plausible",
        F.round("sigma", 2).alias("noise_sigma"),
        F.coalesce(F.when(i % 6 == 0, F.lit(True)).when(i % 6 == 1, F.lit(False)), i % 13 == 0).alias("routed"),
        F.when(i % 17 == 0, F.array(F.lit("mostly_uniform"))).otherwise(F.array().cast("array<string>")).alias("sanity_flags"),
    )
    return score.decide(score.route(q)).select("page_id", "step", "margin", F.col("kept_quad").isNotNull().alias("keeps_quad"), "routed", F.array_join("flags", ",").alias("flags"), "confidence")


@query
def upload_validate(spark, sf_dir):
    """Pages and documents as uploads, and one literal row for each signature and fault."""
    pages = fixtures.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("name"), F.lit("text/html").alias("mime"), F.encode("html", "utf-8").alias("content"))
    docs = fixtures.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 3 == 0, "application/pdf").when(F.col("doc_id") % 3 == 1, "image/png").alias("mime"), F.encode("text", "utf-8").alias("content"))
    rows = [("jpeg", None, "FFD8FFE0"), ("png", None, "89504E470D0A1A0A00"), ("heic", "text/plain", "0000001866747970686569630000"), ("pdf", None, "255044462D312E370A2525454F460A"), ("broken", "image/png", "255044462D312E37"), ("empty", "image/png", ""), ("unknown", "text/plain", "00010203"), ("declared", "image/heif", "00010203")]
    fixed = spark.createDataFrame(rows, "name string, mime string, hex string").select("name", "mime", F.unhex("hex").alias("content"))
    every = pages.unionByName(docs).unionByName(fixed).withColumn("length", F.length("content"))
    return uploads.validate(every).select("name", "length", "kind", "reject_reason")


@query
def born_digital(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", uploads.is_born_digital(F.col("text")).alias("born_digital"))


@query
def page_order(spark, sf_dir):
    """Running orders of pages over the files of a session."""
    p = fixtures.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") % 3).alias("upload"), F.col("turn").alias("page"))
    return uploads.numbered(p)


@query
def page_rotation(spark, sf_dir):
    return catalog.page_state(fixtures.edits(spark, sf_dir)).select("page_id", "rotation")


@query
def page_state(spark, sf_dir):
    inset = F.round(F.col("corners")[0][0], 6).alias("inset")
    return catalog.page_state(fixtures.edits(spark, sf_dir)).select("page_id", inset, "mode", "demoire", "deleted", "n_exports", "n_edits")


@query
def snapshot_state(spark, sf_dir):
    """The states of pages by stored snapshots: the log arrives in four batches, in each of which edits of all times are."""
    where = shared_dir(spark)
    log = fixtures.edits(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(4)).cast("int"))
    for k in range(4):
        tables.write_batch(log.where(F.col("batch") == k).drop("batch"), k, f"{where}/log")
        snapshots.advance(spark, f"{where}/states", tables.read(spark, f"{where}/log"))
    inset = F.round(F.col("corners")[0][0], 6).alias("inset")
    return snapshots.state(snapshots.stored(spark, f"{where}/states")).select("page_id", inset, "mode", "demoire", "deleted", "n_exports", "n_edits", "rotation")


@query
def replayed_batches(spark, sf_dir):
    """Documents stored in three batches, of which one is written again, whole, after a broken attempt: as if once."""
    where = f"{shared_dir(spark)}/table"
    rows = fixtures.table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    part = lambda k: rows.where(F.pmod(F.col("doc_id"), F.lit(3)) == k)
    for k, batch in ((0, part(0)), (1, rows), (2, part(2)), (1, part(1)), (0, part(0))):
        tables.write_batch(batch, k, where)
    return tables.read(spark, where).groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum("size").alias("bytes"))


@query
def changed_pages(spark, sf_dir):
    """Pages whose state differs between half of the log and all of it."""
    log = fixtures.edits(spark, sf_dir)
    half = log.agg((F.max("seq") / 2).alias("m"))
    early = log.join(F.broadcast(half), F.col("seq") <= F.col("m")).drop("m")
    return catalog.to_recompute(catalog.page_state(early), catalog.page_state(log)).select("page_id")


@query
def export_metrics(spark, sf_dir):
    return catalog.export_metrics(fixtures.catalogue(spark, sf_dir))


@query
def session_pdf_objects(spark, sf_dir):
    """Number, place and length of every object of each conversation's file, with few pages a node so that trees are deep."""
    return assembly.assembled(fixtures.turns(spark, sf_dir), "raw", fan=4).objects


@query
def session_pdfs(spark, sf_dir):
    """Pages, objects and bytes of each conversation's file, and a digest of its parts and their places."""
    files = assembly.assembled(fixtures.turns(spark, sf_dir), "raw", fan=4)
    name = F.md5(F.concat(F.encode(F.concat(F.col("at").cast("string"), F.lit(":")), "utf-8"), "data"))
    digests = files.parts.groupBy("session_id").agg(F.sum(F.conv(F.substring(name, 1, 8), 16, 10).cast("long")).alias("digest"), F.count("*").alias("parts"))
    return files.sessions.join(digests, "session_id")


@query
def live_pages(spark, sf_dir):
    """Live pages with their place in the session and what a client sees of them."""
    p = catalog.ordered_pages(fixtures.catalogue(spark, sf_dir).withColumn("confidence", F.col("confidence_pct") / 100.0))
    return catalog.page_view(p).select("id", "session_id", "order", "place", "low_confidence", "passthrough", "preview")


@query
def scan_pages(spark, sf_dir):
    """Sessions with their live pages nested, as a list of orders and ids; sessions without pages stay."""
    p = fixtures.catalogue(spark, sf_dir).withColumn("confidence", F.col("confidence_pct") / 100.0)
    sessions = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    nested = catalog.scans(sessions, p)
    listed = F.array_join(F.transform("pages", lambda x: F.concat_ws(":", x["order"].cast("string"), x["id"])), ",")
    return nested.select("session_id", F.size("pages").alias("n_pages"), listed.alias("pages"))


@query
def page_reorder(spark, sf_dir):
    """Pages after each session's list of new places: every other page, in reverse order of id."""
    p = fixtures.catalogue(spark, sf_dir).dropDuplicates(["id"])
    wanted = p.where(F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 2 == 0).groupBy("session_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("page_ids"))
    return catalog.reorder(p, wanted).select("id", "session_id", "order")


@query
def latest_pdf(spark, sf_dir):
    p = fixtures.catalogue(spark, sf_dir).where("passthrough").select("session_id", "id", F.concat(F.lit("pdfs/"), F.col("id"), F.lit(".pdf")).alias("ref"), "created_at")
    return catalog.latest_pdf(p).select("session_id", "ref", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query
def edit_errors(spark, sf_dir):
    """Why edits cannot be applied, counted."""
    p = fixtures.catalogue(spark, sf_dir).dropDuplicates(["id"])
    n = F.conv(F.substring("id", 1, 3), 16, 10).cast("int")
    log = p.select(
        F.col("id").alias("page_id"),
        "session_id",
        F.element_at(F.array(*map(F.lit, ("recrop", "rotate", "mode", "demoire"))), n % 4 + 1).alias("op"),
        ((n % 8) * 45).alias("degrees"),
        F.element_at(F.array(*map(F.lit, ("color", "gray", "bw", "sepia"))), F.floor(n / 16).cast("int") % 4 + 1).alias("mode"),
        F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), F.floor(n / 4).cast("int") % 3 + 3).alias("corners"),
    )
    return catalog.check_edits(log, p).groupBy("op", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


@query
def low_confidence_pages(spark, sf_dir):
    return catalog.low_confidence_count(fixtures.catalogue(spark, sf_dir), ["passthrough"])


@query
def image_lookup(spark, sf_dir):
    """References of the images of live pages, asked for by session and page; every third page by a wrong session."""
    p = fixtures.catalogue(spark, sf_dir).dropDuplicates(["id"])
    p = p.withColumns({"original_ref": F.concat(F.lit("originals/"), F.col("id"), F.lit(".png")), "processed_ref": F.concat(F.lit("processed/"), F.col("id"), F.lit(".png"))})
    n = F.conv(F.substring("id", 1, 2), 16, 10).cast("int")
    asked = p.select((F.col("session_id") + F.when(n % 3 == 0, 1).otherwise(0)).alias("session_id"), "id", (n % 2 == 0).alias("original"))
    return catalog.page_images(p, asked).select("id", "ref")


@query
def export_handoff(spark, sf_dir):
    p = fixtures.catalogue(spark, sf_dir)
    exports = p.where("not deleted").select("session_id").distinct().withColumn("ref", F.concat(F.lit("pdfs/"), F.col("session_id").cast("string"), F.lit(".pdf")))
    return catalog.handoff(exports, p)


@query
def created_pages(spark, sf_dir):
    """Rows of the page table from processed and from passing pages of sessions that exist."""
    p = fixtures.catalogue(spark, sf_dir).dropDuplicates(["id"])
    sessions = fixtures.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("session_id"))
    made = p.where("not passthrough").select("id", "session_id", "order", F.concat(F.lit("processed/"), F.col("id")).alias("processed_ref"), (F.col("confidence_pct") / 100.0).alias("confidence"), F.array(F.lit("blur")).alias("flags"))
    out = catalog.create_pages(sessions, made, p.where("passthrough").select("id", "session_id", "order"))
    return out.select("id", "session_id", "order", "processed_ref", "passthrough", "confidence", F.array_join("gate_flags", ",").alias("flags"), F.array_join("ops", ",").alias("ops"), "rotation", "mode", "deleted")


@query
def line_turn(spark, sf_dir):
    """The median turn of each label's lines; lines are the vectors' numbers as degrees."""
    e = fixtures.table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", (F.col("x").cast("double") * 90.0).alias("degrees"))
    return geometry.median_turn(e, ["label"]).select("label", r("turn"))
