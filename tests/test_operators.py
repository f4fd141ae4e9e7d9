"""Properties of the operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageforge.kernels import color, light
from pageforge.kernels import stats as kernel
from pageforge.operators import catalog, geometry, rasters, score, stats, uploads


def quad(spark, points):
    return spark.createDataFrame([(1, 1000, 1000, [{"x": float(x), "y": float(y)} for x, y in points])], "page_id long, w int, h int, pts array<struct<x:double,y:double>>")


@pytest.mark.parametrize("turn", range(4))
def test_corner_order_does_not_depend_on_the_first_corner(spark, turn):
    square = [(10, 10), (110, 10), (110, 110), (10, 110)]
    got = quad(spark, square[turn:] + square[:turn]).select(geometry.ordered(F.col("pts")).alias("r")).first()["r"]
    assert [(p["x"], p["y"]) for p in got] == square


def test_flat_and_implausible_outlines(spark):
    flat = geometry.judged(quad(spark, [(5, 5), (995, 5), (995, 995), (5, 995)])).first()
    assert flat["skip_warp"] and flat["plausible"]
    bad = geometry.judged(quad(spark, [(0, 0), (900, 400), (950, 500), (0, 900)])).first()
    assert not bad["plausible"]


def test_raster_round_trip_and_stencils(spark):
    w, h = 23, 19
    data = bytes((x * 7 + y * 13 + c * 29) % 256 for y in range(h) for x in range(w) for c in range(3))
    pages = spark.createDataFrame([(1, (h, w, 3, 16, data))], "page_id long, raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    lines = rasters.scan_lines(pages)
    assert bytes(rasters.pack(lines).first()["raster"]["data"]) == data
    gray = {r["y"]: r["v"] for r in rasters.gray_lines(lines).collect()}
    g = [gray[y] for y in range(h)]
    for y in (0, 7, h - 1):
        b, gg, r = data[(y * w + 3) * 3 : (y * w + 3) * 3 + 3]
        assert g[y][3] == math.floor(0.114 * b + 0.587 * gg + 0.299 * r + 0.5)
    clamp = lambda i, n: max(0, min(n - 1, i))
    m = [[1, -2, 1], [-2, 4, -2], [1, -2, 1]]
    total = sum(abs(sum(m[j][i] * g[clamp(y + j - 1, h)][clamp(x + i - 1, w)] for j in range(3) for i in range(3))) for y in range(h) for x in range(w))
    want = total * math.sqrt(math.pi / 2) / (6 * (w - 2) * (h - 2))
    assert stats.noise_sigma(rasters.gray_lines(lines)).first()["sigma"] == pytest.approx(want)
    # 23 // 8 = 2: eleven tiles across, the last pixel is not looked at; 19 // 8 = 2: nine tiles down
    tiles = rasters.tile_parts(rasters.gray_lines(lines), "v", 8).select("ty", "tx").distinct().count()
    assert tiles == 99
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    px = lambda y, x: g[mirror(y, h)][mirror(x, w)]
    energy = lambda y, x: (sum(k * (px(y + j, x + 1) - px(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))) ** 2 + (sum(k * (px(y + 1, x + i) - px(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))) ** 2
    means = sorted((sum(energy(y, x) for y in (ty, ty + 1) for x in (tx, tx + 1)) / 4 for ty in range(0, 18, 2) for tx in range(0, 22, 2)), reverse=True)
    assert stats.sharpness(rasters.gray_lines(lines)).first()["sharpness"] == pytest.approx(sum(means[:9]) / 9)


def test_confidence_and_flags(spark):
    one = spark.range(1).select(score.confidence(F.array(F.lit("blur")), F.lit(True), F.lit(True), F.lit(True), F.lit(False)).alias("c")).first()
    assert one["c"] == 0.0


def test_first_failing_check_names_the_reason(spark):
    rows = [("a", "image/png", b""), ("b", None, b"x"), ("c", None, b"%PDF-1.7 no end"), ("d", None, b"%PDF-1.7 %%EOF"), ("e", "image/jpeg", b"\xff\xd8\xff")]
    got = uploads.validate(spark.createDataFrame(rows, "name string, mime string, content binary").withColumn("length", F.length("content")))
    assert {r["name"]: r["reject_reason"] for r in got.collect()} == {"a": "empty file", "b": "unsupported file type", "c": "malformed PDF", "d": None, "e": None}


def test_unicode_space_does_not_make_a_page_born_digital(spark):
    text = "　 " * 20 + "x" * 29 + "\x85\n"
    assert not spark.createDataFrame([(text,)], "t string").select(uploads.is_born_digital(F.col("t")).alias("b")).first()["b"]


def test_edit_fold_matches_python(spark):
    import random

    random.seed(4)
    some = lambda: {"degrees": 90 * random.randint(-4, 9), "mode": random.choice(catalog.MODES), "on": random.random() < 0.5, "corners": [[random.random()] * 2] * 4}
    log = [{"page_id": p, "at": i, "seq": i, "op": random.choice(["rotate", "recrop", "mode", "demoire", "delete"])} | some() for p in range(5) for i in range(12)]
    schema = "page_id long, at long, seq long, op string, degrees int, mode string, `on` boolean, corners array<array<double>>"
    got = {r["page_id"]: r for r in catalog.page_state(spark.createDataFrame(log, schema)).collect()}
    for p in range(5):
        turn, mode, wish, gone, corners = 0, "color", None, False, None
        for e in (e for e in log if e["page_id"] == p):
            turn = 0 if e["op"] == "recrop" else (turn + e["degrees"]) % 360 if e["op"] == "rotate" else turn
            corners = e["corners"] if e["op"] == "recrop" else corners
            mode = e["mode"] if e["op"] == "mode" else mode
            wish = e["on"] if e["op"] == "demoire" else wish
            gone = gone or e["op"] == "delete"
        assert (got[p]["rotation"], got[p]["mode"], got[p]["demoire"], got[p]["deleted"], got[p]["corners"]) == (turn, mode, wish, gone, corners)


def test_a_recrop_alone_is_computed_again(spark):
    schema = "page_id long, at long, seq long, op string, degrees int, mode string, `on` boolean, corners array<array<double>>"
    square = lambda a: [[a, a], [1 - a, a], [1 - a, 1 - a], [a, 1 - a]]
    log = spark.createDataFrame([(1, 1, 1, "mode", None, "bw", None, None), (2, 1, 2, "mode", None, "bw", None, None), (1, 2, 3, "recrop", None, None, None, square(0.1)), (2, 2, 4, "export", None, None, None, None)], schema)
    before, after = catalog.page_state(log.where("seq < 3")), catalog.page_state(log)
    assert [r["page_id"] for r in catalog.to_recompute(before, after).collect()] == [1]


@pytest.mark.parametrize("method,skip,plausible,want", [
    # an implausible outline that no model found counts as none, also where it fills the frame
    ("approx", False, False, ("deskew", None, ["boundary_not_found"], 0.75, False)),
    ("rect", True, False, ("deskew", None, ["boundary_not_found"], 0.75, False)),
    ("approx", True, True, ("deskew", None, [], 1.0, True)),
    ("rect", False, True, ("warp", 0.05, ["approx_crop"], 0.9, True)),
    ("model", False, False, ("deskew", None, ["geometry_uncertain"], 0.7, True)),
    ("model", True, False, ("deskew", None, [], 1.0, True)),
    ("model", False, True, ("warp", 0.02, [], 1.0, True)),
    (None, None, None, ("deskew", None, ["boundary_not_found"], 0.75, False)),
])
def test_decisions(spark, method, skip, plausible, want):
    rows = spark.createDataFrame([(None, False, [1] if method else None, method, skip, plausible, [], 0.0, False, [])], "forced array<int>, clean boolean, quad array<int>, method string, skip_warp boolean, plausible boolean, gate_flags array<string>, noise_sigma double, routed boolean, sanity_flags array<string>")
    r = score.decide(score.route(rows)).first()
    assert (r["step"], r["margin"], r["flags"], r["confidence"], r["kept_quad"] is not None) == want


def test_audit_and_orphans(spark):
    event = spark.range(1).select(*catalog.audit(F.lit("me"), "page.rotate", F.lit("p1"), F.create_map(F.lit("deg"), F.lit("90")))).first()
    assert (event["actor"], event["action"], event["target"], event["detail"]) == ("me", "page.rotate", "p1", {"deg": "90"}) and len(event["id"]) == 64 and event["timestamp"]
    pages = spark.createDataFrame([("a", 1), ("b", 2)], "id string, session_id long")
    assert [r["id"] for r in catalog.orphans(pages, spark.createDataFrame([(1,)], "session_id long")).collect()] == ["b"]
    live = spark.createDataFrame([("b", 1, 0, False), ("a", 1, 0, False), ("c", 1, 0, True)], "id string, session_id long, order int, deleted boolean")
    assert [r["id"] for r in catalog.ordered_pages(live).collect()] == ["a", "b"]


def test_reorder_takes_the_last_place_of_doubles(spark):
    pages = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 1, 2)], "id string, session_id long, order int")
    wanted = spark.createDataFrame([(1, ["c", "a", "c"])], "session_id long, page_ids array<string>")
    assert {r["id"]: r["order"] for r in catalog.reorder(pages, wanted).collect()} == {"a": 1, "b": 1, "c": 2}


def test_measures_do_not_depend_on_how_lines_arrive(spark):
    """Sharpness, glare and chroma over lines, a few at a time, against those of whole pages."""
    rng = np.random.default_rng(5)
    shapes = [(23, 19), (1, 9), (2, 64), (64, 1), (64, 64), (9, 200)]
    planes = [np.where(rng.random((*s, 1)) < 0.3, 255, rng.integers(0, 256, (*s, 3))).astype(np.uint8) for s in shapes]
    rows = [(i, (*p.shape[:2], 3, 16, p.tobytes())) for i, p in enumerate(planes)]
    lines = rasters.scan_lines(spark.createDataFrame(rows, "page_id long, raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>"))
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for some in (1, 2, 7, 1000):
            spark.conf.set(key, some)
            got = {r["page_id"]: r for r in stats.gate(rasters.gray_lines(lines)).collect()}
            tints = {r["page_id"]: r for r in stats.chroma(lines).collect()}
            for i, p in enumerate(planes):
                gray, tint = color.gray(p), light.gated(color.lab(p)[..., 1:], 12, 30)
                assert got[i]["sharpness"] == pytest.approx(kernel.sharpness(gray, 8, 0.1)) and got[i]["glare_hot_tiles"] == kernel.hot_tiles(gray, 8, 250, 0.6)
                assert tuple(tints[i])[1:] == (*tint.sum((0, 1), dtype=int), (tint != 128).any(2).sum())
    finally:
        spark.conf.set(key, old)
