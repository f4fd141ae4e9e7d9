"""Page stages on drawn pages: properties of whole results, and kernels against plain definitions."""

import struct
import zlib

import numpy as np
import pytest
from drawn import CHIP, SEAL, sheet, snapshot
from pyspark.sql import functions as F

from pageforge.config import SETTINGS
from pageforge.kernels import color, encode, filters, light, model, outline, pdf, stats, warp
from pageforge.operators import assembly, documents, pages
from pageforge.sources import images


def rasters(spark, arrays, extra="raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>"):
    return spark.createDataFrame([(i, None if a is None else pages.packed(a)) for i, a in enumerate(arrays)], f"page_id long, {extra}")


def ordered(pts):
    a = np.arctan2(pts[:, 1] - pts[:, 1].mean(), pts[:, 0] - pts[:, 0].mean())
    ring = pts[np.argsort(a)]
    return np.roll(ring, -int(ring.sum(1).argmin()), axis=0)


@pytest.mark.parametrize("seed,busy,reach", [(1, False, 0.03), (5, True, 0.10)])
def test_outline_of_a_snapshot(spark, seed, busy, reach):
    page, truth = snapshot(seed=seed, busy=busy)
    row = pages.detect(rasters(spark, [page])).first()
    found = np.array([[p["x"], p["y"]] for p in row["quad"]])
    assert np.sqrt(((found - ordered(truth)) ** 2).sum(1)).max() < reach * np.hypot(*page.shape[:2])


def test_light_keeps_colour():
    page = sheet()
    page = (page * np.linspace(1.0, 0.5, page.shape[0])[:, None, None]).astype(np.uint8)
    flat = light.flattened(page, stats.share_of(page, 180, 45) >= 0.40, SETTINGS.light)
    assert np.percentile(color.saturation(flat[SEAL]), 90) > 60 and np.median(color.saturation(flat[CHIP])) > 80
    assert np.median(flat[10:50]) > 230 and np.median(flat[975:1005]) > 230


def test_whole_way(spark):
    page, truth = snapshot(seed=2, size=0.5)
    empty = np.zeros((0, 10, 3), np.uint8)
    blank = np.full((300, 200, 3), 255, np.uint8)
    rows = rasters(spark, [page, blank, empty, None]).withColumns({"title": F.lit("x"), "output_mode": F.when(F.col("page_id") == 1, "gray")})
    out = {r["page_id"]: r for r in pages.process(rows).collect()}
    done = pages.unpacked(out[0]["raster"].asDict())
    assert 1.0 < done.shape[0] / done.shape[1] < 2.0 and out[0]["confidence"] > 0.4 and done.mean() > 150 and color.saturation(done).max() > 60
    corners = np.array([[p["x"] * page.shape[1], p["y"] * page.shape[0]] for p in out[0]["quad"]])
    assert np.sqrt(((corners - ordered(truth)) ** 2).sum(1)).max() < 0.06 * np.hypot(*page.shape[:2])
    assert set(out[0]["timings_ms"]) == {"gate", "boundary_perspective", "illumination", "denoise", "output"} and out[0]["title"] == "x"
    # a blank page is clean already: only level, no outline; it is blurred, glaring, small, and uniform
    assert out[1]["flags"] == ["blur", "glare", "low_resolution", "sanity_mostly_uniform"] and out[1]["confidence"] == 0.25 and out[1]["quad"] is None and out[1]["mode"] == "gray"
    assert "sanity_empty" in out[2]["flags"] and "sanity_empty" in out[3]["flags"] and out[3]["raster"] is None


def test_forced_corners_and_moire(spark):
    page, _ = snapshot(seed=3, size=0.3)
    rows = rasters(spark, [page]).select("*", F.expr("transform(array(array(0.1, 0.1), array(0.9, 0.1), array(0.9, 0.8), array(0.1, 0.8)), p -> named_struct('x', double(p[0]), 'y', double(p[1])))").alias("forced"), F.lit(True).alias("demoire"))
    out = pages.process(rows, demoire=lambda p: p[::-1]).first()
    done = pages.unpacked(out["raster"].asDict())
    assert done.shape[:2] == (round(0.7 * page.shape[0]), round(0.8 * page.shape[1])) and out["routed"] and "screen_moire" in out["flags"] and "demoire" in out["timings_ms"]
    assert [round(p["x"], 6) for p in out["quad"]] == [0.1, 0.9, 0.9, 0.1]


def test_a_model_finds_corners(spark):
    page, truth = snapshot(seed=5, size=0.3)

    def heat(x):
        h, w = page.shape[:2]
        pad = round(max(h, w) * 0.3)
        out = np.zeros((1, 4, 128, 128), np.float32)
        for k, (cx, cy) in enumerate(truth):
            out[0, k, int((cy + pad) / (h + 2 * pad) * 128), int((cx + pad) / (w + 2 * pad) * 128)] = 1
        return out

    found = pages.corner_model(heat)(page)
    assert np.abs(found - truth).max() < 0.02 * max(page.shape)
    assert pages.corner_model(lambda x: np.zeros((1, 4, 128, 128)))(page) is None and pages.corner_model(lambda x: 1 / 0)(page) is None
    row = pages.detect(rasters(spark, [page]), pages.corner_model(heat)).first()
    assert row["method"] == "model" and row["plausible"]
    assert model.without_moire(page, lambda x: x, 200).shape == page.shape and np.abs(model.without_moire(page, lambda x: x, 2000).astype(int) - page).max() <= 1


def test_quarter_turns_and_level_pages():
    page = sheet()[:700]
    assert (warp.quarter_turns(page, 90)[:, -1] == page[0]).all() and (warp.quarter_turns(page, -270) == warp.quarter_turns(page, 90)).all() and (warp.quarter_turns(page, 45) == page).all()
    for angle in (3, -4):
        tilted = warp.turned(page, angle)
        assert abs(warp.skew(color.gray(tilted)) + angle) <= 1
        assert abs(warp.skew(color.gray(warp.deskewed(tilted, color.gray(tilted))))) <= 1
    rect = np.array([[0, 0], [99, 0], [99, 49], [0, 49]], float)
    assert (warp.warp(page, rect, 100, 50) == page[:50, :100]).all()


def test_filters_against_definitions():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (13, 17)).astype(np.uint8)
    wide = np.pad(x, 2, "reflect").astype(int)
    window = lambda p, r, y, c: p[y : y + 2 * r + 1, c : c + 2 * r + 1]
    dark, high = np.pad(x, 2, constant_values=0), np.pad(x, 2, constant_values=255)
    edge = np.pad(x, 2, "edge")
    for y in range(13):
        for c in range(17):
            assert filters.dilate(x, 5)[y, c] == window(dark, 2, y, c).max() and filters.erode(x, 5)[y, c] == window(high, 2, y, c).min()
            assert filters.median(x, 5)[y, c] == np.median(window(edge, 2, y, c))
            own = window(wide, 2, y, c)
            dy, dx = np.mgrid[-2:3, -2:3]
            k = np.exp(-((own - int(x[y, c])) ** 2) / (2 * 30**2)) * np.exp(-(dx**2 + dy**2) / (2 * 50**2)) * (dx**2 + dy**2 <= 4)
            assert abs(filters.bilateral(x, 5, 30, 50)[y, c] - (k * own).sum() / k.sum()) <= 0.51
    assert (filters.resize(x, 13, 17, area=True) == x).all() and abs(filters.resize(x, 4, 5, area=True).mean() - x.mean()) < 1.5
    flat = np.full((40, 40, 3), 77, np.uint8)
    assert (filters.non_local_means(flat, 5) == 77).all() and (filters.equalized(flat[..., 0], 1.0) == filters.equalized(flat[..., 0], 1.0)[0, 0]).all()
    noisy = np.clip(128 + rng.normal(0, 10, (40, 40, 1)), 0, 255).astype(np.uint8)
    assert filters.non_local_means(noisy, 10).std() < 0.5 * noisy.std()


def test_colours_go_and_come_back():
    page = np.random.default_rng(2).integers(0, 256, (50, 50, 3)).astype(np.uint8)
    assert np.abs(color.from_lab(color.lab(page)).astype(int) - page).mean() < 2
    gray = color.from_gray(np.arange(256, dtype=np.uint8).reshape(16, 16))
    assert (color.gray(gray) == gray[..., 0]).all() and (color.lab(gray)[..., 1:] == 128).all() and (color.saturation(gray) == 0).all()


def test_percentiles_are_numpy_s():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 999):
        x = rng.integers(0, 256, (1, n)).astype(np.uint8)
        assert np.allclose(stats.percentiles(x, 4, 78), (np.percentile(x, 4), np.percentile(x, 78)))


def brute_regions(mask, diagonal):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                    label[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or i == 0 or j == 0]
    return label, n


def test_regions():
    rng = np.random.default_rng(4)
    for k in range(30):
        mask = rng.random((int(rng.integers(1, 20)), int(rng.integers(1, 20)))) < 0.5
        for diagonal in (True, False):
            got, want = outline.regions(mask, diagonal), brute_regions(mask, diagonal)
            assert got[1] == want[1] and (got[0] == want[0]).all()


def test_outlines_of_drawn_shapes():
    mask = np.zeros((100, 120), bool)
    mask[10:61, 20:101] = True
    mask[20:51, 30:91] = False
    found = sorted(((c[0].min(0).tolist(), c[0].max(0).tolist(), c[1]) for c in outline.contours(mask, 50, True)), key=lambda c: -c[2])
    assert found == [([20, 10], [100, 60], 80 * 50), ([29, 19], [91, 51], 62 * 32 - 2)] or found[0] == ([20, 10], [100, 60], 80 * 50) and found[1][:2] == ([29, 19], [91, 51])
    quad = np.array([[10, 12], [90, 20], [85, 95], [14, 80]], float)
    ring = np.concatenate([np.linspace(a, b, 40, endpoint=False) for a, b in zip(quad, np.roll(quad, -1, axis=0))])
    corners, method, _ = outline.fitted(outline.hull(np.rint(ring)))
    assert method == "approx" and np.abs(ordered(corners) - ordered(quad)).max() <= 2
    angle = np.linspace(0, 2 * np.pi, 60)
    _, size = outline.least_rectangle(outline.hull(np.stack([50 + 30 * np.cos(angle), 50 + 30 * np.sin(angle)], 1)))
    assert abs(size - 3600) < 60


def test_jpeg_is_read_by_another_decoder(spark, tmp_path):
    page, _ = snapshot(seed=6, size=0.2)
    odd = page[:101, :67]
    flat = np.full((9, 9, 3), 200, np.uint8)
    for name, p in (("a", page), ("b", odd), ("c", flat)):
        body = encode.jpeg(np.ascontiguousarray(p))
        assert b"Exif" not in body
        (tmp_path / f"{name}.jpg").write_bytes(body)
    rows = {r["origin"][-5]: r for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    for name, p in (("a", page), ("b", odd), ("c", flat)):
        back = np.frombuffer(rows[name]["data"], np.uint8).reshape(p.shape)
        assert np.abs(back.astype(int) - p).mean() < 4


def test_photos_are_turned_upright(spark, tmp_path):
    page = np.zeros((16, 32, 3), np.uint8)
    page[:8, :8] = 255  # upper left
    body = encode.jpeg(page)
    for turn in range(0, 10):
        note = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHHI", 0x0112, 3, 1, turn, 0, 0)
        far = b"\xff\xe2" + struct.pack(">H", 65000) + b"x" * 64998 if turn == 6 else b""
        (tmp_path / f"{turn}.jpg").write_bytes(body[:2] + far + far + b"\xff\xe1" + struct.pack(">H", len(note) + 2) + note + body[2:])
    rows = images.rasters(spark, str(tmp_path)).collect()
    spots = sorted((r["raster"]["height"], r["raster"]["width"], *(int(x) for x in np.argwhere(pages.unpacked(r["raster"].asDict())[..., 0] > 128).mean(0) > [r["raster"]["height"] / 2, r["raster"]["width"] / 2])) for r in rows)
    # the white corner: as it is (0, 1, 9), mirrored, upside down, mirrored upside down; then the four turned ones
    assert spots == sorted([(16, 32, 0, 0)] * 3 + [(16, 32, 0, 1), (16, 32, 1, 1), (16, 32, 1, 0), (32, 16, 0, 0), (32, 16, 0, 1), (32, 16, 1, 1), (32, 16, 1, 0)])


def test_pdf_of_pages(spark):
    page, _ = snapshot(seed=3, size=0.1)
    live = rasters(spark, [page] * 61 + [None]).selectExpr("7L as session_id", "cast(page_id as string) as id", "cast(100 - page_id as int) as order", "page_id = 5 as deleted", "false as passthrough", "cast(null as binary) as pdf", "raster")
    row = assembly.export(live).first()
    assert row["pages"] == 60 and row["pdf"][:5] == b"%PDF-" and b"Exif" not in row["pdf"] and row["pdf"].count(b"/DCTDecode") == 60
    png = assembly.export(live, "png").first()["pdf"]
    body = png[png.index(b"stream\n", png.index(b"/FlateDecode")) + 7 :]
    assert zlib.decompressobj().decompress(body) == page[..., ::-1].tobytes()
    assert documents.image_pdfs(rasters(spark, [page])).first()["pdf"].count(b"/Type /Page ") == 1
    files = images.encoded(rasters(spark, [page, None]), "png").orderBy("page_id").collect()
    assert files[0]["file"][:4] == b"\x89PNG" and files[1]["file"] is None


def text_pdf(text):
    """A page of text with hand-made objects, one of them in an object stream."""
    stream = b"BT /F1 24 Tf 72 700 Td (" + text.encode() + b") Tj [(a\\)b) -20 <6364>] TJ ET"
    held = b"7 0 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] /Rotate 90 >>",
        b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 7 0 R >> >> /Contents 4 0 R >>",
        b"<< /Length 5 0 R >>\nstream\n" + stream + b"\nendstream",
        b"%d" % len(stream),
        b"<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n" % len(zlib.compress(held)) + zlib.compress(held) + b"\nendstream",
    ]
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + body + b"\nendobj\n" for k, body in enumerate(bodies, 1))
    return out + b"trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def test_pages_of_pdf_uploads(spark):
    page, _ = snapshot(seed=7, size=0.1)
    image = documents.write_pdf([(*page.shape[:2], documents.page_stream(page, "png", 95))], 200)
    born = text_pdf("This page was written and never photographed")
    mixed = pdf.joined([(pdf.File(born), pdf.File(born).pages[0], 0), (pdf.File(image), pdf.File(image).pages[0], 0)])
    jpeg_pdf = documents.write_pdf([(*page.shape[:2], documents.page_stream(page, "jpeg", 95))], 200)
    many = pdf.joined([(f := pdf.File(born), f.pages[0], 0)] * 51)
    files = [("mixed", mixed), ("short", text_pdf("only this")), ("jpeg", jpeg_pdf), ("many", many), ("junk", b"%PDF-1.4 nothing %%EOF"), ("none", None), ("locked", born.replace(b"/Root", b"/Encrypt 9 0 R /Root"))]
    out = {}
    for r in documents.split_pdfs(spark.createDataFrame(files, "name string, content binary")).collect():
        out.setdefault(r["name"], []).append((r["page"], r["item_type"], r["error"], r["pdf"], r["raster"]))
    assert [x[:3] for x in out["mixed"]] == [(0, "pdf_page", None), (1, "image", None)]
    assert (pages.unpacked(out["mixed"][1][4].asDict()) == page).all() and out["mixed"][0][4] is None
    own = pdf.File(bytes(out["mixed"][0][3]))
    assert own.text(own.pages[0]) == "This page was written and never photographeda)bcd" and own.pages[0]["/Rotate"] == 90 and b"Helvetica" in out["mixed"][0][3]
    assert [x[1] for x in out["short"]] == ["image"] and out["jpeg"][0][2] == "page needs a rasterizer"
    assert out["many"][0][:3] == (None, None, "PDF has more than 50 pages") and out["locked"][0][2] == "encrypted PDF"
    assert out["junk"][0][2] and out["none"][0][2]


def test_images_and_pdfs_of_a_folder(spark, tmp_path):
    page, _ = snapshot(seed=7, size=0.05)
    (tmp_path / "a.png").write_bytes(images.png(page.shape[0], page.shape[1], page.tobytes()))
    (tmp_path / "b.pdf").write_bytes(text_pdf("This page was written and never photographed"))
    (tmp_path / "c.txt").write_bytes(b"no page")
    out = sorted((r["item_type"], r["page"], r["raster"] is not None, r["pdf"] is not None, r["error"]) for r in images.load(spark, str(tmp_path)).collect())
    assert out == [("image", 0, True, False, None), ("pdf_page", 0, False, True, None)]


def test_export_keeps_text_and_order(spark):
    page, _ = snapshot(seed=7, size=0.1)
    born = text_pdf("Kept as it is")
    raster = pages.packed(page)
    rows = [(1, "b", 1, False, True, born, None), (1, "a", 2, False, False, None, raster), (1, "c", 0, False, False, None, raster), (1, "d", 3, True, True, born, None), (2, "e", 0, True, False, None, raster)]
    table = spark.createDataFrame(rows, "session_id long, id string, `order` int, deleted boolean, passthrough boolean, pdf binary, raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    (one,) = assembly.export(table, "png").collect()
    file = pdf.File(bytes(one["pdf"]))
    assert one["pages"] == 3 and [file.text(p)[:7] for p in file.pages] == ["", "Kept as", ""] and (file.image(file.pages[0]) == page).all()
    turned = documents.turned_pdfs(table.where("passthrough"), F.lit(-90)).first()["pdf"]
    assert pdf.File(bytes(turned)).pages[0]["/Rotate"] == 0 and pdf.File(bytes(turned)).text(pdf.File(bytes(turned)).pages[0]).startswith("Kept")


def test_edited_pages_are_made_anew(spark):
    page, _ = snapshot(seed=8, size=0.1)
    corners = [[0.0, 0.0], [0.5, 0.0], [0.5, 0.8], [0.0, 0.8]]
    state = spark.createDataFrame([(0, corners, "gray", False, 90)], "page_id long, corners array<array<double>>, mode string, demoire boolean, rotation int")
    row = pages.reprocess(rasters(spark, [page]).join(state, "page_id")).first()
    done = pages.unpacked(row["raster"].asDict())
    assert done.shape[:2] == (round(0.5 * page.shape[1]), round(0.8 * page.shape[0])) and (done[..., 0] == done[..., 2]).all() and row["mode"] == "gray" and row["rotation"] == 90


def test_few_edges_have_no_lines(monkeypatch):
    """Pages with fewer edge pixels than a line needs votes are not voted on; small planes have the same medians as large ones."""
    plane = np.zeros((40, 40), np.uint8)
    plane[10:30, 10:30] = 255
    monkeypatch.setattr(warp.np, "bincount", lambda *_, **__: pytest.fail("voted"))
    assert len(warp.line_angles(plane)) == 0
    monkeypatch.undo()
    noisy = np.random.default_rng(8).integers(0, 256, (30, 41)).astype(np.uint8)
    small = filters.median(noisy, 5)
    monkeypatch.setattr(filters, "SMALL", 0)
    assert (filters.median(noisy, 5) == small).all()
