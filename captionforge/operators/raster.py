"""Raster kernels in numpy: RGB arrays (height, width, 3) of bytes or grey ones (height, width), whole images at a time.

They run inside Arrow-fed workers over the image source (`map_images`). What is a count or a comparison of pixels has a relational form
in `pixels` too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Rect = tuple[int, int, int, int]
CONTRAST = 1.4


def intersect(a: Rect, b: Rect) -> Rect:
    """x, y, width, height of what two rectangles share; no width or height if nothing."""
    x, y = max(a[0], b[0]), max(a[1], b[1])
    return x, y, max(0, min(a[0] + a[2], b[0] + b[2]) - x), max(0, min(a[1] + a[3], b[1] + b[3]) - y)


def crop(image: np.ndarray, roi: Rect) -> np.ndarray:
    x, y, w, h = intersect(roi, (0, 0, image.shape[1], image.shape[0]))
    if w <= 0 or h <= 0:
        raise ValueError(f"the region {roi} is outside the image")
    return image[y : y + h, x : x + w]


def upscale(image: np.ndarray, min_width: int = 1200, most: float = 4.0) -> np.ndarray:
    """Scaled to min_width, four times at most, by cubic convolution; wider images stay."""
    h, w = image.shape[:2]
    if w >= min_width:
        return image
    scale = min(min_width / w, most)
    for axis, n in ((0, int(h * scale)), (1, int(w * scale))):
        image = stretched(image, axis, n)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def stretched(image: np.ndarray, axis: int, n: int) -> np.ndarray:
    size = image.shape[axis]
    at = (np.arange(n) + 0.5) * size / n - 0.5
    base = np.floor(at).astype(int)
    out = 0.0
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        weight = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        shape = [1] * image.ndim
        shape[axis] = n
        out = out + np.take(image, np.clip(base + k, 0, size - 1), axis=axis) * weight.reshape(shape)
    return out


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    i = image.astype(np.int32)
    return ((i[:, :, 0] * 77 + i[:, :, 1] * 150 + i[:, :, 2] * 29) >> 8).astype(np.uint8)


def contrast_table(contrast: float = CONTRAST) -> np.ndarray:
    """The byte that each byte becomes."""
    c = np.float32(contrast)
    return np.clip((np.arange(256, dtype=np.float32) * c + np.float32(128) * (1 - c)).astype(np.int32), 0, 255).astype(np.uint8)


def contrast(image: np.ndarray, by: float = CONTRAST) -> np.ndarray:
    return contrast_table(by)[image]


def otsu_threshold(image: np.ndarray) -> int:
    """The first threshold of the greatest variance between classes; 128 if there is but one class."""
    hist = np.bincount(image.ravel(), minlength=256).astype(float)
    below, weight = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (weight / below - (weight[-1] - weight) / above) ** 2
    between = np.where((below > 0) & (above > 0), between, 0)
    return int(between.argmax()) if between.max() > 0 else 128


def binary(mask: np.ndarray) -> np.ndarray:
    return np.where(mask, 255, 0).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    return binary(image > otsu_threshold(image))


def adaptive(image: np.ndarray, constant: int = 10) -> np.ndarray:
    """White where a pixel is brighter than its surroundings' mean less a constant; blocks of an odd size between 15 and 51."""
    g = gray(image)
    h, w = g.shape
    block = max(15, min(51, w // 20))
    half = (block + (block % 2 == 0)) // 2
    table = np.zeros((h + 1, w + 1), np.int64)
    table[1:, 1:] = g.astype(np.int64).cumsum(0).cumsum(1)
    y1, y2 = np.maximum(0, np.arange(h) - half), np.minimum(h, np.arange(h) + half + 1)
    x1, x2 = np.maximum(0, np.arange(w) - half), np.minimum(w, np.arange(w) + half + 1)
    total = table[np.ix_(y2, x2)] - table[np.ix_(y1, x2)] - table[np.ix_(y2, x1)] + table[np.ix_(y1, x1)]
    return binary(g > total // np.outer(y2 - y1, x2 - x1) - constant)


def color_mask(image: np.ndarray) -> np.ndarray:
    """White where the colour is one that subtitles have, or much brighter than its four neighbours."""
    i = image.astype(np.int32)
    r, g, b = i[:, :, 0], i[:, :, 1], i[:, :, 2]
    high, low, bright = i.max(2), i.min(2), i.sum(2) // 3
    saturation = np.where(high == 0, 0, (high - low) * 255 // np.maximum(high, 1))
    plain = (bright >= 150) & (saturation <= 80)
    yellow = (r >= 180) & (g >= 160) & (b < 130) & (r + g > 360)
    cyan = (r < 130) & (g >= 180) & (b >= 180)
    green = (g >= 200) & (r >= 150) & (b < 130)
    stands_out = np.zeros(bright.shape, bool)
    if min(bright.shape) > 2:
        around = (bright[1:-1, :-2] + bright[1:-1, 2:] + bright[:-2, 1:-1] + bright[2:, 1:-1]) // 4
        stands_out[1:-1, 1:-1] = bright[1:-1, 1:-1] - around > 40
    return binary(plain | yellow | cyan | green | (stands_out & (bright >= 130) & (saturation <= 100)))


def spread(image: np.ndarray, radius: int, take: Callable) -> np.ndarray:
    """The extreme over squares of 2 radius + 1, edges repeated; first along one axis, then the other."""
    for axis in (0, 1):
        n = image.shape[axis]
        image = take.reduce([np.take(image, np.clip(np.arange(n) + d, 0, n - 1), axis=axis) for d in range(-radius, radius + 1)])
    return image


def dilate(image: np.ndarray, radius: int = 1) -> np.ndarray:
    return spread(image, radius, np.maximum)


def erode(image: np.ndarray, radius: int = 1) -> np.ndarray:
    return spread(image, radius, np.minimum)


def close_gaps(image: np.ndarray, radius: int = 1) -> np.ndarray:
    return erode(dilate(image, radius), radius)


def preprocess(image: np.ndarray, mode: str = "Auto", upscaled: bool = True, morphology: bool = False) -> np.ndarray:
    """An image made ready for recognition, scaled up and then in black and white; Auto is Otsu."""
    if upscaled:
        image = upscale(image)
    if mode == "Adaptive":
        out = adaptive(image)
    elif mode == "ColorBased":
        out = close_gaps(color_mask(image))
    else:
        out = otsu(contrast(gray(image)))
        if mode == "Invert":
            out = 255 - out
    return close_gaps(out) if morphology else out


def text_ratios(image: np.ndarray, region: Rect) -> tuple[float, float, float]:
    """Shares of a region's pixels that are bright, that are edges and that are of high contrast to the left or above."""
    x, y, w, h = intersect(region, (0, 0, image.shape[1], image.shape[0]))
    if w <= 0 or h <= 0:
        return 0.0, 0.0, 0.0
    g = gray(image)[y : y + h, x : x + w].astype(np.int32)
    change = np.maximum(np.abs(g[1:, 1:] - g[1:, :-1]), np.abs(g[1:, 1:] - g[:-1, 1:]))
    return (g > 200).sum() / g.size, (change > 50).sum() / g.size, (change > 100).sum() / g.size


def score_of_ratios(bright: float, edge: float, contrast: float) -> float:
    score = 0.3 * (1 - abs(bright - 0.15) / 0.35) if 0.02 <= bright <= 0.50 else 0.0
    score += 0.4 * (edge / 0.10) if 0.005 <= edge <= 0.20 else 0.0
    score += 0.3 * (contrast / 0.05) if 0.002 <= contrast <= 0.15 else 0.0
    return min(1.0, score)


def text_score(image: np.ndarray, region: Rect) -> float:
    return score_of_ratios(*text_ratios(image, region))


def candidates(width: int, height: int) -> list[tuple[Rect, float]]:
    """Where subtitles are looked for, and how much each place counts. (Fixed values.)"""
    return [
        ((width // 6, int(height * 0.78), width * 2 // 3, int(height * 0.18)), 1.0),
        ((0, int(height * 0.75), width, int(height * 0.22)), 0.9),
        ((width // 10, int(height * 0.80), width * 4 // 5, int(height * 0.16)), 0.85),
        ((width // 6, int(height * 0.02), width * 2 // 3, int(height * 0.12)), 0.5),
    ]


def padded(region: Rect, width: int, height: int) -> Rect:
    """A twentieth of its width and a tenth of its height more on every side, within the frame."""
    px, py = region[2] // 20, region[3] // 10
    x, y = max(0, region[0] - px), max(0, region[1] - py)
    return x, y, min(width - x, region[2] + 2 * px), min(height - y, region[3] + 2 * py)


def detect_region(image: np.ndarray) -> tuple[Rect, float]:
    """The region where text is likeliest, padded, and the confidence from 0 to 100."""
    h, w = image.shape[:2]
    best, top = candidates(w, h)[0][0], 0.0
    for region, weight in candidates(w, h):
        if (score := text_score(image, region) * weight) > top:
            best, top = region, score
    return padded(best, w, h), min(100.0, 100 * top)


def has_subtitle(image: np.ndarray) -> bool:
    h, w = image.shape[:2]
    return text_score(image, candidates(w, h)[0][0]) > 0.15


def pixels_of(data: bytes, width: int, height: int) -> np.ndarray:
    """RGB of the image source's rows (BGR or BGRA, or grey)."""
    i = np.frombuffer(data, np.uint8).reshape(height, width, -1)
    return i[:, :, 2::-1] if i.shape[2] >= 3 else np.repeat(i, 3, axis=2)


def map_images(frames: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str, keys: list[str]) -> DataFrame:
    """keys and the kernel's columns for each frame (columns data, width, height beside the keys), a batch at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: getattr(f, k) for k in keys} | kernel(pixels_of(f.data, f.width, f.height)) for f in batch.itertuples()]
            yield pd.DataFrame(rows, columns=names)

    return frames.select(*keys, "data", "width", "height").mapInPandas(run, schema)
