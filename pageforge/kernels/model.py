"""What surrounds models for corners and moire: their inputs and the reading of their outputs.  The models come from outside."""

from __future__ import annotations

import numpy as np

from pageforge.kernels.filters import _resample, enlarged, resize
from pageforge.kernels.outline import blob_center

# The border and size of the corner model's input, the fill of the moire model's border (r, g, b).
BORDER, SIZE, HEAT = (40, 40, 40), 256, 0.2
FILL, STEP = (0.3827, 0.4141, 0.3912), 32
#: The longest edge that the moire model sees, a fixed value too.
MOST = 1280


def corner_input(page: np.ndarray, share: float) -> tuple[np.ndarray, int]:
    """The page within a border, as [1, 3, 256, 256] from 0 to 1, and the border's width."""
    pad = round(max(page.shape[:2]) * share)
    wide = np.pad(page, ((pad, pad), (pad, pad), (0, 0)), constant_values=BORDER[0])
    return resize(wide, SIZE, SIZE).transpose(2, 0, 1)[None].astype(np.float32) / 255.0, pad


def corners_of(heat: np.ndarray, height: int, width: int, pad: int) -> np.ndarray | None:
    """Four corners on the page from [4, h, w] heat; None where a corner has no heat."""
    spots = []
    for plane in heat[:4]:
        spot = blob_center(_resample(_resample(plane, height + 2 * pad, 0, False), width + 2 * pad, 1, False), HEAT)
        if spot is None:
            return None
        spots.append((min(max(spot[0] - pad, 0), width - 1), min(max(spot[1] - pad, 0), height - 1)))
    return np.array(spots)


def border_to(size: int, step: int = STEP) -> tuple[int, int]:
    """Pixels before and after that make a multiple of the step."""
    spare = -size % step
    return spare // 2, spare - spare // 2


def without_moire(page: np.ndarray, model, most: int = MOST) -> np.ndarray:
    """The page through a model that takes and gives [1, 3, h, w], on a smaller copy where it is large; as it is where the model gives nothing."""
    h, w = page.shape[:2]
    scale = min(1.0, most / max(h, w))
    small = resize(page, max(1, round(h * scale)), max(1, round(w * scale)), area=True) if scale < 1 else page
    down, across = border_to(small.shape[0]), border_to(small.shape[1])
    x = np.stack([np.pad(small[..., 2 - k] / 255.0, (down, across), constant_values=FILL[k]) for k in range(3)])[None].astype(np.float32)
    out = model(x)
    if out is None:
        return page
    out = np.clip(np.asarray(out)[0, :, down[0] : down[0] + small.shape[0], across[0] : across[0] + small.shape[1]], 0, 1)
    clean = (out[::-1].transpose(1, 2, 0) * 255).astype(np.uint8)
    return enlarged(clean, h, w) if scale < 1 else clean
