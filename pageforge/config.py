"""Settings of the page engine, passed to the stages that use them."""

from __future__ import annotations

from dataclasses import dataclass, field


# The numbers of every group are fixed values: results must agree with those of the page service.


@dataclass(frozen=True)
class Upload:
    """What uploads may be."""

    max_bytes: int = 40 * 1024 * 1024
    max_pixels: int = 60_000_000
    max_pages: int = 50
    mimes: tuple[str, ...] = ("image/jpeg", "image/png", "image/heic", "image/heif", "application/pdf")


@dataclass(frozen=True)
class Ingest:
    """Sizes for detection and gate, characters of a page that counts as written."""

    detect_edge: int = 1500
    low_edge: int = 800
    born_digital_chars: int = 30


@dataclass(frozen=True)
class Gate:
    """Sharpness and glare by tiles."""

    sharp: float = 500.0
    content: float = 0.10
    grid: int = 8
    glare_value: int = 250
    glare_share: float = 0.60
    glare_tiles: int = 2


@dataclass(frozen=True)
class Boundary:
    """Outlines that count."""

    min_area: float = 0.18
    max_cover: float = 0.985
    top: int = 8
    paper_sat: int = 40
    paper_val: int = 150
    rect_factor: float = 0.85


@dataclass(frozen=True)
class Perspective:
    """When and how far pages are warped."""

    flat_cover: float = 0.92
    flat_skew: float = 2.0
    margin: float = 0.05
    model_margin: float = 0.02
    min_angle: float = 55.0
    max_angle: float = 125.0
    max_ratio: float = 2.6


@dataclass(frozen=True)
class Light:
    """Flattening of light and gating of chroma."""

    estimate_edge: int = 256
    close_share: float = 0.25
    tiles: int = 8
    median: int = 5
    clean_share: float = 0.75
    clean_val: int = 200
    clean_sat: int = 40
    paper_share: float = 0.40
    paper_val: int = 180
    paper_sat: int = 45
    document: tuple[float, float, int, float, float] = (4.0, 78.0, 32, 1.0, 2.0)  # black and white percentile, floor, gamma, clip of contrast
    photo: tuple[float, float, int, float, float] = (2.0, 98.0, 0, 1.0, 1.0)
    moire_white: float = 60.0
    gate_low: float = 12.0
    gate_high: float = 30.0


@dataclass(frozen=True)
class Adaptive:
    """Strength of denoising and sharpening, route to the moire stage."""

    skip: float = 2.0
    light: float = 5.0
    heavy: float = 9.0
    light_color: int = 12
    strong_color: int = 30
    amounts: tuple[float, float, float] = (0.35, 0.45, 0.60)  # none, bilateral, nlm
    radius: float = 0.8
    moire: float = 4.3
    moire_amount: float = 0.40
    rerun_amount: float = 0.85
    grid: int = 10


@dataclass(frozen=True)
class Sanity:
    """Shapes and emptiness of results."""

    min_aspect: float = 0.4
    max_aspect: float = 3.5
    uniform: float = 0.98


@dataclass(frozen=True)
class Output:
    """Encoding, resolution, the confidence that counts as low."""

    encoding: str = "jpeg"
    quality: int = 95
    dpi: int = 200
    low_confidence: float = 0.6


@dataclass(frozen=True)
class Settings:
    upload: Upload = field(default_factory=Upload)
    ingest: Ingest = field(default_factory=Ingest)
    gate: Gate = field(default_factory=Gate)
    boundary: Boundary = field(default_factory=Boundary)
    perspective: Perspective = field(default_factory=Perspective)
    light: Light = field(default_factory=Light)
    adaptive: Adaptive = field(default_factory=Adaptive)
    sanity: Sanity = field(default_factory=Sanity)
    output: Output = field(default_factory=Output)


SETTINGS = Settings()
