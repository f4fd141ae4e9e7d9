"""Gray, saturation, value and Lab of BGR pages on 8-bit scales, by the published formulae."""

from __future__ import annotations

import numpy as np

_BYTE = np.arange(256) / 255.0
_LINEAR = np.where(_BYTE <= 0.04045, _BYTE / 12.92, ((_BYTE + 0.055) / 1.055) ** 2.4)
#: sRGB at D65: red, green, blue to X, Y, Z over the white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_RGB = np.linalg.inv(_XYZ)
_STEPS = 1 << 12
_S = np.arange(_STEPS + 1) / _STEPS
_GAMMA = np.floor(255 * np.where(_S <= 0.0031308, 12.92 * _S, 1.055 * _S ** (1 / 2.4) - 0.055) + 0.5).astype(np.uint8)
#: Rows that are worked on at a time, so that doubles of a few lines are held only.
_ROWS = 64


def gray(page: np.ndarray) -> np.ndarray:
    return np.floor(0.114 * page[..., 0] + 0.587 * page[..., 1] + 0.299 * page[..., 2] + 0.5).astype(np.uint8)


def from_gray(plane: np.ndarray) -> np.ndarray:
    return np.repeat(plane[..., None], 3, axis=2)


def saturation(page: np.ndarray) -> np.ndarray:
    top, low = page.max(2).astype(np.int32), page.min(2)
    return np.where(top > 0, np.floor((top - low) * 255.0 / np.maximum(top, 1) + 0.5), 0).astype(np.uint8)


def value(page: np.ndarray) -> np.ndarray:
    return page.max(2)


def lab(page: np.ndarray) -> np.ndarray:
    out = np.empty(page.shape, np.uint8)
    for y in range(0, len(page), _ROWS):
        b, g, r = (_LINEAR[page[y : y + _ROWS, :, k]] for k in range(3))
        x, mid, z = ((m[0] * r + m[1] * g + m[2] * b) / w for m, w in zip(_XYZ, _WHITE))
        fx, fy, fz = (np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0) for t in (x, mid, z))
        light = np.where(mid > 0.008856, 116.0 * np.cbrt(mid) - 16.0, 903.3 * mid)
        for k, c in enumerate((light * 255.0 / 100.0, 500.0 * (fx - fy) + 128.0, 200.0 * (fy - fz) + 128.0)):
            out[y : y + _ROWS, :, k] = np.clip(np.floor(c + 0.5), 0, 255)
    return out


def from_lab(page: np.ndarray) -> np.ndarray:
    out = np.empty(page.shape, np.uint8)
    for y in range(0, len(page), _ROWS):
        l, a, b = (page[y : y + _ROWS, :, k].astype(np.float64) for k in range(3))
        l *= 100.0 / 255.0
        fy = np.where(l > 8.0, (l + 16.0) / 116.0, l / 903.3 * 7.787 + 16.0 / 116.0)
        f = (fy + (a - 128.0) / 500.0, fy, fy - (b - 128.0) / 200.0)
        xyz = [np.where(t > 0.206893, t**3, (t - 16.0 / 116.0) / 7.787) * w for t, w in zip(f, _WHITE)]
        for k, m in enumerate(_RGB[::-1]):
            light = np.clip(m[0] * xyz[0] + m[1] * xyz[1] + m[2] * xyz[2], 0.0, 1.0)
            out[y : y + _ROWS, :, k] = _GAMMA[(light * _STEPS + 0.5).astype(np.int32)]
    return out
