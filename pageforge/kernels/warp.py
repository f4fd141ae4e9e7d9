"""Perspective and rotation of pages, and the turn of their text lines."""

from __future__ import annotations

import numpy as np

from pageforge.kernels.outline import canny

_ROWS = 128


def homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrices [n, 3, 3] that take four points to four others each; points are [n, 4, 2]."""
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    one, no = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, no, no, no, -u * x, -u * y], -1), np.stack([no, no, no, x, y, one, -v * x, -v * y], -1)], 2).reshape(-1, 8, 8)
    found = np.linalg.solve(rows, target.reshape(-1, 8, 1))[..., 0]
    return np.concatenate([found, np.ones((len(found), 1))], 1).reshape(-1, 3, 3)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 by 3 matrix that takes four points to four others."""
    return homographies(np.asarray(source, float)[None], np.asarray(target, float)[None])[0]


def _linear(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels; black outside of the page."""
    h, w = page.shape[:2]
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    out = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            i, j = y0 + dy, x0 + dx
            weight = (y - y0 if dy else 1 - (y - y0)) * (x - x0 if dx else 1 - (x - x0))
            weight = weight * ((i >= 0) & (i < h) & (j >= 0) & (j < w))
            out = out + page[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)] * weight[..., None]
    return np.floor(out + 0.5).astype(np.uint8)


def warp(page: np.ndarray, rect: np.ndarray, width: int, height: int) -> np.ndarray:
    """The area within four ordered corners as an upright page."""
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    if width == 1 or height == 1:  # a line has no inverse map; its points lie evenly between the corners
        fx, fy = (np.arange(n) / max(n - 1, 1) for n in (width, height))
        top, bottom = (a + (b - a) * fx[:, None] for a, b in ((rect[0], rect[1]), (rect[3], rect[2])))
        spot = top[None] + (bottom - top)[None] * fy[:, None, None]
        return _linear(page, spot[..., 0], spot[..., 1])
    m = homography(target, np.asarray(rect, float))
    out = np.empty((height, width, 3), np.uint8)
    x = np.arange(width)
    for a in range(0, height, _ROWS):
        y = np.arange(a, min(a + _ROWS, height))[:, None]
        z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        out[a : a + _ROWS] = _linear(page, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z)
    return out


def line_angles(plane: np.ndarray, votes: int = 200, most: int = 100) -> np.ndarray:
    """Degrees from the horizontal of the straight lines with the most votes, one degree and one pixel apart."""
    ys, xs = np.nonzero(canny(plane, 50, 150))
    h, w = plane.shape
    far = h + w
    found = np.zeros((182, 2 * far + 3), np.int32)
    if len(xs) <= votes:  # no line can have more votes than there are edges
        return np.empty(0)
    for t in range(180):
        rho = np.rint(xs * np.cos(np.pi * t / 180) + ys * np.sin(np.pi * t / 180)).astype(np.int64) + far + 1
        found[t + 1] = np.bincount(rho, minlength=2 * far + 3)
    core = found[1:-1, 1:-1]
    top = (core > votes) & (core > found[1:-1, :-2]) & (core >= found[1:-1, 2:]) & (core > found[:-2, 1:-1]) & (core >= found[2:, 1:-1])
    theta, rho = np.nonzero(top)
    first = np.lexsort((theta * core.shape[1] + rho, -core[theta, rho]))[:most]
    return theta[first] - 90.0


def skew(plane: np.ndarray) -> float:
    """The median turn of near-horizontal lines in degrees; 0 where there are none."""
    angles = line_angles(plane)
    angles = angles[(angles > -45) & (angles < 45)]
    return float(np.median(angles)) if len(angles) else 0.0


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    a = -0.75
    inner = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    outer = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [outer(t + 1), inner(t), inner(1 - t), outer(2 - t)]


def turned(page: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned counter-clockwise about its centre, same size, edges replicated, by cubic interpolation."""
    h, w = page.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    out = np.empty_like(page)
    x = np.arange(w) - w / 2
    for a in range(0, h, _ROWS):
        y = np.arange(a, min(a + _ROWS, h))[:, None] - h / 2
        u, v = c * x - s * y + w / 2, s * x + c * y + h / 2
        i, j = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        across, total = _cubic(u - j), 0.0
        for dy, down in enumerate(_cubic(v - i)):
            line = np.clip(i + dy - 1, 0, h - 1)
            for dx in range(4):
                total = total + page[line, np.clip(j + dx - 1, 0, w - 1)] * (down * across[dx])[..., None]
        out[a : a + _ROWS] = np.clip(np.floor(total + 0.5), 0, 255)
    return out


def deskewed(page: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The page turned level; turns below half a degree stay."""
    angle = skew(plane)
    return page if abs(angle) < 0.5 else turned(page, angle)


def quarter_turns(page: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise turns by multiples of 90 degrees; others leave the page as it is."""
    return np.ascontiguousarray(np.rot90(page, -(degrees % 360 // 90))) if degrees % 90 == 0 else page
