"""Edges, connected regions and the outlines of pages."""

from __future__ import annotations

import numpy as np

from pageforge.kernels.filters import dilate, erode, sobel

#: Shares of the hull's length that its outline may be simplified by, tried in this order.
SHARES = (0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10)


def regions(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1..n of the connected regions of a mask, 0 elsewhere: runs of a line, joined where they touch the line above."""
    h, w = mask.shape
    p = np.zeros((h, w + 2), np.int8)
    p[:, 1:-1] = mask
    d = np.diff(p, axis=1)
    row, start = np.nonzero(d == 1)
    _, end = np.nonzero(d == -1)  # exclusive
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int32), 0
    far = 1 if diagonal else 0
    span = w + 4
    # Runs of the line above that end behind a run's start and start before its end.
    low = np.searchsorted(row * span + end, (row - 1) * span + start + 1 - far)
    high = np.searchsorted(row * span + start, (row - 1) * span + end + far)
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), count)
    b = low[a] + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:  # every run takes the least label of those it touches, and then that label's own
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    _, label = np.unique(root, return_inverse=True)
    marks = np.zeros((h, w + 1), np.int32)
    marks[row, start] = label + 1
    marks[row, end] -= (label + 1).astype(np.int32)
    return np.cumsum(marks[:, :-1], 1, dtype=np.int32), int(label.max()) + 1


def thresholds(gray: np.ndarray) -> tuple[int, int]:
    """Between which gradients edges may go on: a third below and above the median, cut to whole numbers."""
    middle = float(np.median(gray))
    return int(max(0.0, (1.0 - 0.33) * middle)), int(min(255.0, (1.0 + 0.33) * middle))


def canny(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the gradient (sum of the absolute derivatives) above `low` that hang together with one above `high`."""
    gx, gy = sobel(plane, "edge")
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = plane.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    same = (gx < 0) == (gy < 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    ridge = (size > low) & (size > before) & (np.where(flat | steep, size >= after, size > after))
    label, n = regions(ridge)
    strong = np.zeros(n + 1, bool)
    strong[label[ridge & (size > high)]] = True
    strong[0] = False
    return strong[label]


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull in order."""
    pts = np.unique(points, axis=0).astype(np.float64)
    if len(pts) < 3:
        return pts

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    rows = pts.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def area(corners: np.ndarray) -> float:
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2)


def length(corners: np.ndarray) -> float:
    return float(np.sqrt(((corners - np.roll(corners, -1, axis=0)) ** 2).sum(1)).sum())


def simplified(corners: np.ndarray, reach: float) -> np.ndarray:
    """A closed outline without the corners that lie within `reach` of the line between those that stay."""
    far = lambda k: int(((corners - corners[k]) ** 2).sum(1).argmax())
    a = far(far(0))
    ring = np.roll(corners, -a, axis=0)
    ring = np.concatenate([ring, ring[:1]])
    middle = int(((ring[:-1] - ring[0]) ** 2).sum(1).argmax())
    keep, todo = {0, middle}, [(0, middle), (middle, len(ring) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        (x, y), (dx, dy) = ring[i], ring[j] - ring[i]
        off = np.abs(dx * (ring[i + 1 : j, 1] - y) - dy * (ring[i + 1 : j, 0] - x)) / max(np.hypot(dx, dy), 1e-9)
        k = int(off.argmax())
        if off[k] > reach:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(keep)]


def least_rectangle(corners: np.ndarray) -> tuple[np.ndarray, float]:
    """The corners and the area of the smallest rectangle around a convex outline; one of its sides lies on the outline."""
    d = np.roll(corners, -1, axis=0) - corners
    angle = np.unique(np.arctan2(d[:, 1], d[:, 0]) % (np.pi / 2))
    along = np.stack([np.cos(angle), np.sin(angle)], 1)
    across = np.stack([-np.sin(angle), np.cos(angle)], 1)
    u, v = corners @ along.T, corners @ across.T
    k = int(((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))).argmin())
    low, high = (u[:, k].min(), v[:, k].min()), (u[:, k].max(), v[:, k].max())
    box = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]])
    return box @ np.stack([along[k], across[k]]), float((high[0] - low[0]) * (high[1] - low[1]))


def _outer(filled: np.ndarray, y: int, x: int) -> tuple[np.ndarray, float]:
    """Hull and area of the line through the border pixels of a region without holes."""
    p = np.pad(filled, 1)
    border = filled & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    rows = np.flatnonzero(filled.any(1))
    left, right = filled.argmax(1), filled.shape[1] - 1 - filled[:, ::-1].argmax(1)
    points = np.concatenate([np.stack([left[rows] + x, rows + y], 1), np.stack([right[rows] + x, rows + y], 1)])
    return hull(points), max(0.0, float(filled.sum() - border.sum() / 2 - 1))


def contours(mask: np.ndarray, least: float, holes: bool) -> list[tuple[np.ndarray, float]]:
    """(hull, area) of the outer borders of regions, and of their holes' borders, whose bounding boxes have at least an area."""
    out = []
    h, w = mask.shape
    for inner in (False, True) if holes else (False,):
        label, n = regions(~mask if inner else mask, diagonal=not inner)
        if not n:
            continue
        ys, xs = np.nonzero(label)
        which = label[ys, xs]
        box = np.array([[h, w, -1, -1]] * (n + 1))
        for k, (values, pick) in enumerate(((ys, np.minimum), (xs, np.minimum), (ys, np.maximum), (xs, np.maximum))):
            pick.at(box[:, k], which, values)
        sizes = (box[:, 2] - box[:, 0] + (3 if inner else 1)) * (box[:, 3] - box[:, 1] + (3 if inner else 1))
        for k in np.flatnonzero(sizes >= least):
            y0, x0, y1, x1 = box[k]
            if k == 0 or y1 < 0 or inner and (y0 == 0 or x0 == 0 or y1 == h - 1 or x1 == w - 1):
                continue  # the ground around everything is no hole
            own = np.pad(label[y0 : y1 + 1, x0 : x1 + 1] == k, 1)
            if inner:  # its border runs through the pixels around it
                own = dilate(own.astype(np.uint8), 3).astype(bool)
                y0, x0 = y0 - 1, x0 - 1
            else:
                own = own[1:-1, 1:-1]
            ground, m = regions(np.pad(~own, 1, constant_values=True), diagonal=False)
            filled = (ground != ground[0, 0])[1:-1, 1:-1]
            out.append(_outer(filled, int(y0), int(x0)))
    return out


def edge_mask(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thick edges with small gaps closed."""
    return erode(dilate(dilate(canny(plane, low, high).astype(np.uint8), 9), 7), 7).astype(bool)


def paper_mask(saturation: np.ndarray, value: np.ndarray, most_saturation: int, least_value: int) -> np.ndarray:
    """Bright areas without much colour; specks go first, then gaps and text are filled."""
    paper = ((saturation < most_saturation) & (value > least_value)).astype(np.uint8)
    return erode(dilate(dilate(erode(paper, 9), 9), 25), 25).astype(bool)


def convex(corners: np.ndarray) -> bool:
    p = corners.astype(np.int64)
    d = np.roll(p, -1, axis=0) - p
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool((turn > 0).all() or (turn < 0).all())


def fitted(corners: np.ndarray) -> tuple[np.ndarray, str, float]:
    """Four corners for a hull, how they were found, and the area of the least rectangle around it."""
    box, size = least_rectangle(corners)
    around = length(corners)
    for share in SHARES:
        quad = simplified(corners, share * around)
        if len(quad) == 4 and convex(quad):
            return quad, "approx", size
    return box, "rect", size


def blob_center(heat: np.ndarray, threshold: float) -> tuple[float, float] | None:
    """x and y of the centre of the largest region that is at least as hot as the threshold."""
    label, n = regions(heat >= threshold)
    if not n:
        return None
    sizes = np.bincount(label.ravel(), minlength=n + 1)
    ys, xs = np.nonzero(label == 1 + int(sizes[1:].argmax()))
    return float(xs.mean()), float(ys.mean())
