"""Regions of runs and lines by votes, against plain definitions."""

import numpy as np
from drawn import sheet
from pyspark.sql import functions as F
from test_pages import brute_regions

from pageforge.kernels import color, outline, warp
from pageforge.operators import lines, regions


def mask_lines(spark, masks):
    rows = [(i, y, [bool(v) for v in line], "x") for i, m in enumerate(masks) for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "page_id long, y int, on array<boolean>, root string")


def plain(mask, diagonal):
    label, n = brute_regions(mask, diagonal)
    out = set()
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        out.add((int(y[0]), int(x[0]), len(y), int(x.min()), int(y.min()), int(x.max()), int(y.max()), round(float(x.mean()), 6), round(float(y.mean()), 6)))
    return out


def spiral(n):
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    for leg in range(2 * n):
        steps = 0
        while 0 <= y + dy < n and 0 <= x + dx < n and not m[y + dy, x + dx] and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]):
            y, x, steps = y + dy, x + dx, steps + 1
            m[y, x] = True
        dy, dx = dx, -dy
        if not steps:
            break
    return m


def test_regions_equal_plain_ones(spark):
    rng = np.random.default_rng(21)
    masks = [rng.random((int(rng.integers(1, 30)), int(rng.integers(1, 150)))) < p for p in (0.1, 0.3, 0.5, 0.6, 0.9)]
    masks += [np.zeros((4, 5), bool), np.ones((3, 200), bool), np.eye(40, dtype=bool), spiral(41)]
    for diagonal in (True, False):
        found = regions.regions(regions.labelled(regions.runs(mask_lines(spark, masks), F.col("on")), diagonal))
        got = {}
        for r in found.collect():
            got.setdefault(r["page_id"], set()).add((*tuple(r)[1:8], round(r["cx"], 6), round(r["cy"], 6)))
        for i, m in enumerate(masks):
            assert got.get(i, set()) == plain(m, diagonal), i


def test_a_long_bar_takes_few_rounds(spark, tmp_path):
    tall = np.zeros((600, 3), bool)
    tall[:, 1] = True
    found = regions.labelled(regions.runs(mask_lines(spark, [tall]), F.col("on")), where=str(tmp_path))
    assert found.select("root").distinct().count() == 1 and len(list(tmp_path.glob("edges-*"))) <= 14


def test_edge_cases_of_masks(spark):
    rows = [(1, 0, None), (1, 1, []), (1, 2, [None, True, None, True]), (None, 0, [True]), (1, 3, [True])]
    held = regions.runs(spark.createDataFrame(rows, "page_id long, y int, on array<boolean>"), F.col("on"))
    assert sorted((r["page_id"] or 0, r["y"], r["start"], r["end"]) for r in held.collect()) == [(0, 0, 0, 0), (1, 2, 1, 1), (1, 2, 3, 3), (1, 3, 0, 0)]
    assert regions.regions(regions.labelled(held.where("false"))).count() == 0


def test_largest_region_is_the_heat_s_centre(spark):
    rng = np.random.default_rng(5)
    planes = [rng.integers(0, 256, (9, 12)).astype(np.uint8) for _ in range(20)]
    found = {r["page_id"]: (r["cx"], r["cy"]) for r in regions.largest(regions.regions(regions.labelled(regions.runs(mask_lines(spark, [p >= 170 for p in planes]), F.col("on"))))).collect()}
    for i, p in enumerate(planes):
        assert np.allclose(found[i], outline.blob_center(p, 170))


def plain_lines(ys, xs, least, most):
    c, s = ([round(f(np.pi * t / 180) * 65536) for t in range(180)] for f in (np.cos, np.sin))
    votes = {}
    for y, x in zip(ys, xs):
        for t in range(180):
            key = t, (x * c[t] + y * s[t] + 32768) // 65536
            votes[key] = votes.get(key, 0) + 1
    at = lambda t, r: votes.get((t, r), 0)
    top = [(-n, t, r) for (t, r), n in votes.items() if n > least and n > at(t, r - 1) and n >= at(t, r + 1) and n > at(t - 1, r) and n >= at(t + 1, r)]
    return [(t, r, -n) for n, t, r in sorted(top)[:most]]


def test_lines_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    ys, xs = rng.integers(0, 40, 300).tolist(), rng.integers(0, 60, 300).tolist()
    ys += [5 + x // 9 for x in range(60)]
    xs += list(range(60))
    edges = spark.createDataFrame([(1, y, x) for y, x in zip(ys, xs)], "page_id long, y int, x int")
    got = [(r["theta"], r["rho"], r["n"]) for r in lines.lines(edges, 10, 12).collect()]
    assert sorted(got) == sorted(plain_lines(ys, xs, 10, 12))
    few = [t - 90 for t, _, _ in plain_lines(ys, xs, 40, 100)]
    assert few and lines.turns(lines.lines(edges, 40)).first()["turn"] == np.median(few)
    assert lines.turns(lines.lines(edges.where("false"))).count() == 0


def test_turn_of_a_sheet(spark):
    page = sheet()[:500, :600]
    rows, want = [], {}
    for i, angle in enumerate((0, 3, -4)):
        gray = color.gray(warp.turned(page, angle))
        want[i] = warp.skew(gray)
        rows += [(i, int(y), int(x)) for y, x in zip(*np.nonzero(outline.canny(gray, 50, 150)))]
    got = {r["page_id"]: r["turn"] for r in lines.turns(lines.lines(spark.createDataFrame(rows, "page_id int, y int, x int"), 150)).collect()}
    assert set(got) == set(want) and all(abs(got[i] + a) <= 1 for i, a in enumerate((0, 3, -4)))


def test_regions_across_seams(spark):
    """Runs that arrive a few at a time, lines that batches cut, and short strips: the same regions, by edges at seams alone."""
    rng = np.random.default_rng(4)
    masks = [rng.random((37, 50)) < 0.5, spiral(31), np.ones((9, 9), bool), rng.random((20, 300)) < 0.6]
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for some, strip in ((1, 100), (40, 5), (10000, 1)):
            spark.conf.set(key, some)
            for diagonal in (True, False):
                found = regions.regions(regions.labelled(regions.runs(mask_lines(spark, masks), F.col("on")), diagonal, strip=strip)).collect()
                for i, m in enumerate(masks):
                    assert {(*tuple(r)[1:8], round(r["cx"], 6), round(r["cy"], 6)) for r in found if r["page_id"] == i} == plain(m, diagonal), (some, diagonal, i)
    finally:
        spark.conf.set(key, old)


def test_whole_pages_in_a_batch_leave_no_edges(spark, tmp_path):
    masks = [np.random.default_rng(k).random((30, 40)) < 0.5 for k in range(6)]
    regions.labelled(regions.runs(mask_lines(spark, masks), F.col("on")), where=str(tmp_path)).count()
    assert spark.read.parquet(f"{tmp_path}/edges-0").count() < 60  # of about 1700; a partition's last line comes in a batch of its own
