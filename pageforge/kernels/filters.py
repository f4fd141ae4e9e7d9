"""Neighbourhood filters and scaling of planes and pages."""

from __future__ import annotations

import numpy as np

#: Pixels up to which calls cost more than arithmetic.
SMALL = 1 << 12


def padded(plane: np.ndarray, n: int, mode: str = "reflect") -> np.ndarray:
    """Borders mirrored about the outermost pixel, as far as there are pixels to mirror."""
    wide = [(n, n), (n, n)] + [(0, 0)] * (plane.ndim - 2)
    return np.pad(plane, wide, mode if min(plane.shape[:2]) > 1 or mode != "reflect" else "edge")


def _line(plane: np.ndarray, taps: np.ndarray, axis: int, mode: str) -> np.ndarray:
    r = len(taps) // 2
    wide = [(0, 0)] * plane.ndim
    wide[axis] = (r, r)
    p = np.pad(plane, wide, mode if plane.shape[axis] > 1 or mode != "reflect" else "edge")
    n = plane.shape[axis]
    out = 0
    for k, t in enumerate(taps):
        if t:
            out = out + t * (p[k : k + n] if axis == 0 else p[:, k : k + n])
    return out


def separable(plane: np.ndarray, down: np.ndarray, across: np.ndarray, mode: str = "reflect") -> np.ndarray:
    return _line(_line(plane.astype(np.float64), np.asarray(across, np.float64), 1, mode), np.asarray(down, np.float64), 0, mode)


def sobel(plane: np.ndarray, mode: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    """The derivatives across and down."""
    return separable(plane, (1, 2, 1), (-1, 0, 1), mode), separable(plane, (-1, 0, 1), (1, 2, 1), mode)


def gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred 8-bit planes: a kernel of three deviations on each side."""
    size = int(round(6 * sigma + 1)) | 1
    x = np.arange(size) - size // 2
    taps = np.exp(-(x**2) / (2 * sigma**2))
    taps /= taps.sum()
    return np.clip(np.floor(separable(plane, taps, taps) + 0.5), 0, 255).astype(np.uint8)


def _window(plane: np.ndarray, size: int, axis: int, pick) -> np.ndarray:
    """pick (maximum or minimum) over windows of `size` along an axis, by doubling; borders count as neutral."""
    neutral = np.iinfo(plane.dtype).min if pick is np.maximum else np.iinfo(plane.dtype).max
    n, before = plane.shape[axis], size // 2
    cut = (lambda i, j: slice(i, j)) if axis == 0 else (lambda i, j: (slice(None), slice(i, j)))
    shape = list(plane.shape)
    shape[axis] += size - 1
    p = np.full(shape, neutral, plane.dtype)
    p[cut(before, before + n)] = plane
    span, m = 1, n + size - 1
    while 2 * span <= size:
        p, m = pick(p[cut(0, m - span)], p[cut(span, m)]), m - span
        span *= 2
    if span < size:
        p = pick(p[cut(0, m - (size - span))], p[cut(size - span, m)])
    return p


def dilate(plane: np.ndarray, size: int) -> np.ndarray:
    return _window(_window(plane, size, 0, np.maximum), size, 1, np.maximum)


def erode(plane: np.ndarray, size: int) -> np.ndarray:
    return _window(_window(plane, size, 0, np.minimum), size, 1, np.minimum)


def _ellipse(plane: np.ndarray, size: int, pick) -> np.ndarray:
    r = size // 2
    neutral = np.iinfo(plane.dtype).min if pick is np.maximum else np.iinfo(plane.dtype).max
    p = np.pad(plane, ((r, r), (0, 0)), constant_values=neutral)
    out = None
    for dy in range(-r, r + 1):
        half = int(round(r * np.sqrt(max(0, r * r - dy * dy)) / r)) if r else 0
        row = _window(p[r + dy : r + dy + len(plane)], 2 * half + 1, 1, pick)
        out = row if out is None else pick(out, row)
    return out


def close_ellipse(plane: np.ndarray, size: int) -> np.ndarray:
    return _ellipse(_ellipse(plane, size, np.maximum), size, np.minimum)


def _resample(plane: np.ndarray, n: int, axis: int, area: bool) -> np.ndarray:
    p = np.moveaxis(plane.astype(np.float32), axis, 0)
    m, shape = len(p), (-1, *[1] * (p.ndim - 1))
    out = 0.0
    if area:  # each new line is a mean of the few old ones that it covers
        at = np.arange(n + 1) * (m / n)
        low = np.minimum((at[:-1] + 1e-9).astype(int), m - 1)
        for k in range(int(np.ceil(m / n)) + 1):
            line = low + k
            part = np.clip(np.minimum(at[1:], line + 1) - np.maximum(at[:-1], line), 0, None) * (n / m)
            out = out + p[np.minimum(line, m - 1)] * part.astype(np.float32).reshape(shape)
    else:
        at = np.clip((np.arange(n) + 0.5) * (m / n) - 0.5, 0, m - 1)
        low = at.astype(int)
        part = (at - low).astype(np.float32).reshape(shape)
        out = p[low] * (1 - part) + p[np.minimum(low + 1, m - 1)] * part
    return np.moveaxis(out, 0, axis)


def resize(page: np.ndarray, height: int, width: int, area: bool = False) -> np.ndarray:
    """8-bit pages by the mean of what a pixel covers, or by linear interpolation between pixel centres."""
    return np.clip(np.floor(_resample(_resample(page, height, 0, area), width, 1, area) + 0.5), 0, 255).astype(np.uint8)


def _cubic(plane: np.ndarray, n: int, axis: int) -> np.ndarray:
    p = np.moveaxis(plane.astype(np.float64), axis, 0)
    m, a = len(p), -0.75  # a fixed value of the kernel
    at = (np.arange(n) + 0.5) * (m / n) - 0.5
    low, out = np.floor(at).astype(int), 0.0
    for k in range(-1, 3):
        t = np.abs(at - low - k).reshape(-1, *[1] * (p.ndim - 1))
        near, far = ((a + 2) * t - (a + 3)) * t * t + 1, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
        out = out + p[np.clip(low + k, 0, m - 1)] * np.where(t <= 1, near, far)
    return np.moveaxis(out, 0, axis)


def enlarged(page: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit pages by cubic interpolation between pixel centres, edges replicated."""
    return np.clip(np.floor(_cubic(_cubic(page, height, 0), width, 1) + 0.5), 0, 255).astype(np.uint8)


def bilateral(page: np.ndarray, size: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    """Means of a disc's pixels, weighted by nearness in place and colour (the sum of the channels' differences)."""
    planes = np.ascontiguousarray(page[None] if page.ndim == 2 else np.moveaxis(page, 2, 0))
    r, (n, h, w) = size // 2, planes.shape
    p = np.stack([padded(c, r) for c in planes])
    wide = p.astype(np.float32)
    by_color = np.exp(-(np.arange(255 * n + 1) ** 2) / (2 * sigma_color**2))
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
    tables = {d: (by_color * np.exp(-(d[0] ** 2 + d[1] ** 2) / (2 * sigma_space**2))).astype(np.float32) for d in disc}
    out = np.empty((n, h, w), np.uint8)
    some = max(32, SMALL // w)
    for y in range(0, h, some):  # some lines at a time, so that they stay in the cache
        rows = min(some, h - y)
        here = planes[:, y : y + rows]
        total, weight = np.zeros((n, rows, w), np.float32), np.zeros((rows, w), np.float32)
        for dy, dx in disc:
            at = (slice(None), slice(y + r + dy, y + r + dy + rows), slice(r + dx, r + dx + w))
            off = np.maximum(p[at], here) - np.minimum(p[at], here)
            k = tables[dy, dx].take(off[0] if n == 1 else off.sum(0, dtype=np.uint16))
            total += k * wide[at]
            weight += k
        out[:, y : y + rows] = total / weight + np.float32(0.5)
    return out[0] if page.ndim == 2 else np.ascontiguousarray(np.moveaxis(out, 0, 2))


def _means(plane: np.ndarray, size: int) -> np.ndarray:
    """Means of windows that lie inside the plane."""
    sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    np.cumsum(np.cumsum(plane, 0), 1, out=sums[1:, 1:])
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / (size * size)


def non_local_means(planes: np.ndarray, strength: float, patch: int = 7, search: int = 21) -> np.ndarray:
    """Means of the search window's pixels, weighted by how alike the patches around them are."""
    h, w, n = planes.shape
    r, q = search // 2, patch // 2
    p = padded(planes, r + q).astype(np.float32)
    total, weight = np.zeros((h, w, n)), np.zeros((h, w))
    core = p[r : r + h + 2 * q, r : r + w + 2 * q]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            there = p[r + dy : r + dy + h + 2 * q, r + dx : r + dx + w + 2 * q]
            k = np.exp(-_means(((there - core) ** 2).sum(2), patch) / (strength * strength * n))
            total += there[q : q + h, q : q + w] * k[..., None]
            weight += k
    return np.floor(total / weight[..., None] + 0.5).astype(np.uint8)


def median(plane: np.ndarray, size: int) -> np.ndarray:
    """Medians of square windows of 8-bit pixels, with edges replicated, bit by bit: the greatest value that half of a window reaches."""
    r, (h, w) = size // 2, plane.shape
    p = padded(plane, r, "edge")
    out = np.empty_like(plane)
    some = max(32, SMALL // w)
    for y in range(0, h, some):  # some lines at a time, so that they stay in the cache
        rows = min(some, h - y)
        shifts = [p[y + dy : y + dy + rows, dx : dx + w] for dy in range(size) for dx in range(size)]
        if rows * w <= SMALL:  # one call instead of hundreds
            every = np.stack(shifts)
            shifts = None
        value = np.zeros((rows, w), np.uint8)
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            higher = value | np.uint8(bit)
            if shifts is None:
                count = (every >= higher).view(np.uint8).sum(0, dtype=np.uint8)
            else:
                count = np.zeros((rows, w), np.uint8)
                for there in shifts:
                    count += there >= higher
            value = np.where(count > size * size // 2, higher, value)
        out[y : y + rows] = value
    return out


def level_tables(counts: np.ndarray, area: int, clip: float) -> np.ndarray:
    """What tiles make of each level, from the counts of their levels, [tiles, 256]: clipped, what is cut off given back, added up."""
    most = max(1, int(clip * area / 256))
    spare = np.maximum(counts - most, 0).sum(1)
    rest = spare % 256
    step = np.maximum(1, 256 // np.maximum(rest, 1))  # what is left goes to bins at even distances
    bins = np.arange(256)
    held = np.minimum(counts, most) + (spare // 256)[:, None]
    held += (bins % step[:, None] == 0) & (bins // step[:, None] < rest[:, None])
    return np.clip(np.floor(np.cumsum(held, 1) * (255.0 / area) + 0.5), 0, 255).astype(np.uint8)


def looked_up(lines: np.ndarray, y: np.ndarray, tables: np.ndarray, th: int, tw: int) -> np.ndarray:
    """Lines (at the places y) by the tables of a grid of tiles, [grid, grid, 256], between the middles of four tiles."""
    grid = len(tables)
    at = lambda n, t: np.clip((n + 0.0) / t - 0.5, 0, grid - 1)
    y, x = at(y, th), at(np.arange(lines.shape[1]), tw)
    y0, x0 = y.astype(np.int64), x.astype(np.int64)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (y - y0)[:, None], x - x0
    flat = tables.ravel()
    pick = lambda j, i: flat.take(((j * grid)[:, None] + i) * 256 + lines)
    return np.floor((pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx) * (1 - fy) + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy + 0.5).astype(np.uint8)


def equalized(plane: np.ndarray, clip: float, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalization over a grid of tiles."""
    h, w = plane.shape
    th, tw = -(-h // grid), -(-w // grid)
    p = np.pad(plane, ((0, th * grid - h), (0, tw * grid - w)), "reflect" if min(h, w) > max(th * grid - h, tw * grid - w) else "edge")
    tiles = p.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, th * tw).astype(np.int64)
    counts = np.bincount((tiles + 256 * np.arange(grid * grid)[:, None]).ravel(), minlength=256 * grid * grid).reshape(-1, 256)
    tables = level_tables(counts, th * tw, clip).reshape(grid, grid, 256)
    out = np.empty_like(plane)
    for a in range(0, h, 64):
        out[a : a + 64] = looked_up(plane[a : a + 64], np.arange(a, min(a + 64, h)), tables, th, tw)
    return out


def sauvola(plane: np.ndarray, size: int = 25, k: float = 0.2, reach: float = 127.5) -> np.ndarray:
    """The threshold of each pixel, from mean and deviation of its window."""
    p = padded(plane, size // 2).astype(np.float64)
    mean = _means(p, size)
    spread = np.sqrt(np.maximum(_means(p * p, size) - mean * mean, 0))
    return mean * (1 + k * (spread / reach - 1))
