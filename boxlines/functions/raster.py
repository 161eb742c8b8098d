"""Numpy helpers on one raster (height, width[, channels]), run by Spark a batch of images at a time."""

from __future__ import annotations

import numpy as np


def gray_to_bgr(image: np.ndarray) -> np.ndarray:
    """One channel to three equal ones; others stay."""
    return np.repeat(image.reshape(*image.shape[:2], 1), 3, axis=2) if image.ndim == 2 or image.shape[2] == 1 else image


def flatten_alpha(image: np.ndarray) -> np.ndarray:
    """A fourth channel is laid over white; fractions are cut off."""
    if image.ndim < 3 or image.shape[2] != 4:
        return image
    alpha = image[..., 3:].astype(np.float64) / 255
    return (image[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def median_color(image: np.ndarray, seed: int = 0, sample: int = 1000) -> list[int]:
    """Median of each channel, fraction cut off: of all pixels, or of `sample` drawn by the seed."""
    flat = image.reshape(-1, image.shape[2])
    if len(flat) > sample:
        flat = flat[np.random.default_rng(seed).choice(len(flat), sample, replace=False)]
    return [int(x) for x in np.median(flat, axis=0)]


def grid_median(image: np.ndarray, step: int = 50) -> list[int]:
    """Median of each channel over every step-th row and column."""
    return [int(x) for x in np.median(image[::step, ::step].reshape(-1, image.shape[2]), axis=0)]


def is_dark(median: list[int]) -> bool:
    return sum(median) / len(median) < 128


def pad_border(image: np.ndarray, border: int = 10) -> np.ndarray:
    out = np.full((image.shape[0] + 2 * border, image.shape[1] + 2 * border, image.shape[2]), 255, dtype=np.uint8)
    out[border:-border, border:-border] = image
    return out


def preprocess(image: np.ndarray, seed: int = 0) -> np.ndarray:
    """Three channels on white, dark images inverted, with a white border."""
    image = flatten_alpha(gray_to_bgr(image))
    return pad_border(255 - image if is_dark(median_color(image, seed)) else image)


def polygon_mask(shape: tuple[int, int], rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """Pixels whose centres lie inside by the even-odd rule, a row of pixels at a time."""
    mask = np.zeros(shape, dtype=bool)
    for y in range(shape[0]):
        cuts = []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 <= y) != (y2 <= y):
                    cuts.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2], strict=False):
            mask[y, max(0, int(np.ceil(a))) : max(0, int(np.floor(b)) + 1)] = True
    return mask


def blend(image: np.ndarray, mask: np.ndarray, color: tuple[int, int, int], part: float = 0.3) -> np.ndarray:
    out = image.astype(np.float64)
    out[mask] = out[mask] * (1 - part) + np.array(color) * part
    return np.rint(out).astype(np.uint8)


def box_mask(shape: tuple[int, int], x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    mask = np.zeros(shape, dtype=bool)
    mask[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)] = True
    return mask


def outline(mask: np.ndarray, width: int = 2) -> np.ndarray:
    """The mask's pixels within `width` of its edge."""
    p = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), dtype=bool)
    inner = mask
    for _ in range(width):
        p[1:-1, 1:-1] = inner
        inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask & ~inner


def keep_only(image: np.ndarray, mask: np.ndarray, gray: int = 220) -> np.ndarray:
    """White outside the mask; pure white inside becomes gray."""
    out = image.copy()
    out[mask & (image == 255).all(axis=2)] = gray
    out[~mask] = 255
    return out


def _neighbours(ink: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from the one above."""
    p = np.pad(ink, 1)
    h, w = ink.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def close_ink(ink: np.ndarray, size: int) -> np.ndarray:
    """Grows and then shrinks the ink by a square of the size, so that small gaps close."""
    before, after = (size - 1) // 2, size // 2
    grown = np.zeros_like(ink)
    p = np.pad(ink, ((after, before), (after, before)))
    for dy in range(size):
        for dx in range(size):
            grown |= p[dy : dy + ink.shape[0], dx : dx + ink.shape[1]]
    shrunk = np.ones_like(ink)
    p = np.pad(grown, ((before, after), (before, after)), constant_values=True)
    for dy in range(size):
        for dx in range(size):
            shrunk &= p[dy : dy + ink.shape[0], dx : dx + ink.shape[1]]
    return shrunk


def thin(ink: np.ndarray) -> np.ndarray:
    """Thins lines to one pixel, by two alternating parallel passes that take off border pixels which are no
    line ends and whose neighbours stay connected."""
    ink = ink.astype(bool).copy()
    while True:
        gone = 0
        for first in (True, False):
            n = _neighbours(ink)
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(n, n[1:] + n[:1], strict=True))
            one = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6]) if first else ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
            off = ink & (count >= 2) & (count <= 6) & (turns == 1) & one
            gone += int(off.sum())
            ink &= ~off
        if not gone:
            return ink


def skeleton(image: np.ndarray, scale: float) -> np.ndarray:
    """Ink is what is not pure white; it is closed by a square of int(2 scale), at least 1, and thinned."""
    flat = gray_to_bgr(image)[..., :3].astype(np.float64)
    gray = flat @ np.array([0.114, 0.587, 0.299])
    return thin(close_ink(np.rint(gray) <= 254, max(1, int(2 * scale))))
