"""Models that Spark ships, the moire stage around one, audit events: what fails never fails the pages."""

import numpy as np
import pytest
from drawn import snapshot
from pyspark.sql import functions as F
from test_pages import rasters

from pageforge.kernels import filters, model
from pageforge.operators import catalog, pages
from pageforge.operators.rasters import per_page
from pageforge.sources import models


def loads(tmp_path, marker):
    """A loader that leaves a mark each time that it runs."""

    def load(path):
        with open(marker, "a") as f:
            f.write("x")
        (factor,) = np.load(path)
        if factor < 0:
            raise ValueError("not for this machine")
        return lambda x: x * np.float32(factor)

    return load


def test_a_shipped_model_is_loaded_once_a_worker(spark, tmp_path):
    np.save(tmp_path / "half.npy", np.array([0.5]))
    shipped = models.Shipped(spark, str(tmp_path / "half.npy"), loads(tmp_path, str(tmp_path / "good")))
    page = np.full((4, 4, 3), 100, np.uint8)
    table = rasters(spark, [page] * 40).repartition(4)
    rows = per_page(table, lambda p, _: {"v": float(shipped(p.astype(np.float32))[0, 0, 0])}, "v double")
    assert {r["v"] for r in rows.collect()} == {50.0}
    assert 1 <= len((tmp_path / "good").read_text()) <= 8  # workers, not pages


@pytest.mark.parametrize("content", [b"no array", None])
def test_a_load_that_failed_is_remembered(spark, tmp_path, content):
    np.save(tmp_path / "bad.npy", np.array([-1.0]))
    if content:
        (tmp_path / "bad.npy").write_bytes(content)
    shipped = models.Shipped(spark, str(tmp_path / "bad.npy"), loads(tmp_path, str(tmp_path / "tried")))
    page, _ = snapshot(seed=5, size=0.1)
    table = rasters(spark, [page] * 12).repartition(3)
    assert pages.detect(table, pages.corner_model(shipped)).where("method = 'model'").count() == 0
    clean = pages.moire_model(shipped)
    same = per_page(table, lambda p, _: {"same": bool((clean(p) == p).all())}, "same boolean")
    assert {r["same"] for r in same.collect()} == {True}
    assert len((tmp_path / "tried").read_text()) <= 8


def test_a_model_that_fails_on_a_page(spark, tmp_path):
    np.save(tmp_path / "half.npy", np.array([0.5]))
    shipped = models.Shipped(spark, str(tmp_path / "half.npy"), lambda path: lambda x: 1 / 0)
    assert shipped(np.zeros(3)) is None


def test_moire_stage_borders_and_sizes():
    seen = []

    def run(x):
        seen.append(x)
        return x

    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (50, 70, 3)).astype(np.uint8)
    assert np.abs(pages.moire_model(run)(page).astype(int) - page).max() <= 1
    assert seen[0].shape == (1, 3, 64, 96) and np.allclose(seen[0][0, :, 0, 0], model.FILL) and np.allclose(seen[0][0, :, 7 + 3, 13 + 5] * 255, page[3, 5, ::-1], atol=1e-4)
    smooth = filters.gaussian(np.tile(np.linspace(0, 255, 200).astype(np.uint8), (120, 1)), 3.0)
    large = np.repeat(smooth[..., None], 3, 2)
    back = pages.moire_model(run, most=100)(large)
    assert seen[1].shape == (1, 3, 64, 128) and back.shape == large.shape and np.abs(back.astype(int) - large).max() <= 3
    assert (pages.moire_model(lambda x: None)(page) == page).all() and (pages.moire_model(lambda x: 1 / 0)(page) == page).all()


def test_enlarging_keeps_what_is_flat_and_follows_curves():
    flat = np.full((5, 6, 3), 77, np.uint8)
    assert (filters.enlarged(flat, 11, 13) == 77).all() and (filters.enlarged(flat, 5, 6) == flat).all()
    curve = (100 + 60 * np.sin(np.arange(24) / 4)).astype(np.uint8)
    x = (np.arange(96) + 0.5) / 4 - 0.5
    got = filters.enlarged(np.tile(curve, (4, 1)), 4, 96)[0]
    assert np.abs(got[8:-8] - (100 + 60 * np.sin(x / 4))[8:-8]).max() < 2.5
    linear = filters.resize(np.tile(curve, (4, 1)), 4, 96)[0]
    assert np.abs(got[8:-8] - (100 + 60 * np.sin(x / 4))[8:-8]).mean() <= np.abs(linear[8:-8] - (100 + 60 * np.sin(x / 4))[8:-8]).mean()


def test_moire_and_modes_in_the_whole_way(spark):
    page, _ = snapshot(seed=3, size=0.15)
    rows = rasters(spark, [page] * 3).withColumns({"demoire": F.lit(True), "output_mode": F.when(F.col("page_id") == 1, "sepia").when(F.col("page_id") == 2, "gray")})
    out = {r["page_id"]: r for r in pages.process(rows, demoire=pages.moire_model(lambda x: x)).collect()}
    assert [out[k]["mode_error"] for k in range(3)] == [None, "unknown output mode sepia", None]
    assert all("demoire" in out[k]["timings_ms"] and out[k]["raster"] is not None for k in range(3))


def test_audit_events_count_what_is_written(spark, tmp_path):
    rows, seen = catalog.counted(spark.range(50), pages=F.count("*"), last=F.max("id"))
    rows.write.parquet(str(tmp_path / "out"))
    assert catalog.record(spark, str(tmp_path / "events"), "me", "scan.export", "s1", seen)
    assert catalog.record(spark, str(tmp_path / "events"), "me", "page.rotate", "p1", {"degrees": 90})
    found = {r["action"]: r for r in catalog.events(spark, str(tmp_path / "events")).collect()}
    assert found["scan.export"]["detail"] == {"pages": "50", "last": "49"} and found["page.rotate"]["detail"] == {"degrees": "90"}
    assert found["scan.export"]["timestamp"] is not None and found["scan.export"]["id"] != found["page.rotate"]["id"]
    (tmp_path / "file").write_text("not a folder")
    assert catalog.record(spark, str(tmp_path / "file" / "events"), "me", "scan.export", "s1", {}) is False
