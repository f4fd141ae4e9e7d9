"""Equalization of scan lines against the kernel of whole pages."""

import numpy as np
import pytest
from test_pages import rasters

from pageforge.kernels import filters
from pageforge.operators import contrast
from pageforge.operators.rasters import gray_lines, scan_lines
from pageforge.sources import fixtures


@pytest.mark.parametrize("shape,clip", [((64, 64), 2.0), ((41, 53), 2.0), ((40, 90), 1.0), ((9, 11), 2.0), ((3, 30), 4.0), ((80, 64), 0.2)])
def test_lines_equal_the_kernel(spark, shape, clip):
    rng = np.random.default_rng(sum(shape))
    smooth = filters.gaussian(rng.integers(0, 256, shape).astype(np.uint8), 1.0)
    planes = [rng.integers(0, 256, shape).astype(np.uint8), smooth, np.full(shape, 7, np.uint8)]
    lines = gray_lines(scan_lines(rasters(spark, [np.repeat(p[..., None], 3, 2) for p in planes])))
    got = np.zeros((len(planes), *shape), int)
    for r in contrast.equalized(lines, clip).collect():
        got[r["page_id"], r["y"]] = r["v"]
    for k, p in enumerate(planes):
        apart = np.abs(got[k] - filters.equalized(p, clip))
        assert apart.max() <= 1 and (apart > 0).mean() < 0.02  # halves may fall either way


def test_no_lines(spark):
    lines = gray_lines(scan_lines(rasters(spark, [None])))
    assert contrast.equalized(lines, 2.0).count() == 0


def test_large_pages_hold_their_counts_alone(spark):
    rng = np.random.default_rng(3)
    planes = [rng.integers(0, 256, s).astype(np.uint8) for s in ((41, 53), (64, 64), (3, 30))]
    lines = gray_lines(scan_lines(rasters(spark, [np.repeat(p[..., None], 3, 2) for p in planes])))
    got = {(r["page_id"], r["y"]): r["v"] for r in contrast.equalized(lines, 2.0, held=100).collect()}  # tables come first for two of them
    assert got == {(k, y): line for k, p in enumerate(planes) for y, line in enumerate(filters.equalized(p, 2.0).tolist())}


def test_painted_lines(spark, tmp_path):
    """Pixels of vectors, also where a component or a label is null."""
    rows = [(i, i % 4, [float(v) for v in np.random.default_rng(i).normal(0, 0.3, 64)]) for i in range(700)]
    rows += [(900, 2, [None] + [0.5] * 63), (901, None, [0.5] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["page_id"], r["y"]): r["v"] for r in fixtures.gray64(spark, str(tmp_path)).collect()}
    assert len(got) == 64 * 702 and got[900, 0] == [255] * 64 and got[900, 1][:2] == [255, 91] and got[901, 5] == [255] * 64
    e = np.float32(rows[650][2]).astype(float)
    assert got[650, 7] == np.clip(np.floor(28 * 2 + 10 + 5 * 3 * (e[7] + e)), 0, 255).astype(int).tolist()
