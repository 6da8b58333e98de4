"""What JPEG compression does to pixels: everything but the entropy coding, which loses nothing."""

from __future__ import annotations

from functools import cache

import numpy as np

# The standard's example quantisation tables, row by row.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
CHROMINANCE = (
    (17, 18, 24, 47, 99, 99, 99, 99),
    (18, 21, 26, 66, 99, 99, 99, 99),
    (24, 26, 56, 99, 99, 99, 99, 99),
    (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
)
# Luma weights of red, green and blue, and the scales of the two colour differences.
LUMA, BLUE_SCALE, RED_SCALE = (0.299, 0.587, 0.114), 1.772, 1.402
#: Halves round away from zero although sums of cosines miss them by a little.
NUDGE = 1e-6


@cache
def cosines() -> np.ndarray:
    """The orthonormal cosine transform of eight values: row k holds frequency k."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos(np.pi * (2 * n + 1) * k / 16)


def scaled(table, quality: int) -> np.ndarray:
    """A quantisation table at a quality of 1 to 100."""
    quality = min(max(int(quality), 1), 100)
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def nearest(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5 + NUDGE)


def quantised(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of (..., 8, 8) samples of 0 to 255."""
    c = cosines()
    return nearest(c @ (blocks - 128.0) @ c.T / table)


def restored(coefficients: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Samples of 0 to 255 from quantised coefficients."""
    c = cosines()
    return np.clip(np.floor(c.T @ (coefficients * table) @ c + 128.5 + NUDGE), 0, 255)


def plane(samples: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One channel there and back, block by block; edges are repeated to whole blocks."""
    h, w = samples.shape
    full = np.pad(samples, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)
    return restored(quantised(blocks, table), table).swapaxes(1, 2).reshape(full.shape)[:h, :w]


def halved(samples: np.ndarray) -> np.ndarray:
    """Means of two by two samples, halves up and down in turn."""
    full = np.pad(samples, ((0, samples.shape[0] % 2), (0, samples.shape[1] % 2)), mode="edge").astype(np.int64)
    sums = full[0::2, 0::2] + full[0::2, 1::2] + full[1::2, 0::2] + full[1::2, 1::2]
    return ((sums + 1 + np.arange(sums.shape[1]) % 2) // 4).astype(float)


def doubled(samples: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Twice the samples each way: three parts of the nearer and one of the further neighbour, edges repeated."""
    x = samples.astype(np.int64)
    for axis in (0, 1):
        before = np.concatenate([x.take([0], axis), x], axis).take(range(x.shape[axis]), axis)
        after = np.concatenate([x, x.take([-1], axis)], axis).take(range(1, x.shape[axis] + 1), axis)
        pair = np.stack([3 * x + before, 3 * x + after], axis + 1)
        x = pair.reshape([2 * n if k == axis else n for k, n in enumerate(x.shape)])
    return ((x + 8 - np.arange(x.shape[1]) % 2) // 16)[: size[0], : size[1]].astype(float)


def compressed(pixels: np.ndarray, quality: int) -> np.ndarray:
    """RGB bytes of shape (h, w, 3) after compression at a quality with colours at half the resolution."""
    rgb = pixels.astype(float)
    luma = rgb @ np.array(LUMA)
    to_byte = lambda x: np.clip(np.floor(x + 0.5 + NUDGE), 0, 255)
    y, cb, cr = to_byte(luma), to_byte((rgb[:, :, 2] - luma) / BLUE_SCALE + 128), to_byte((rgb[:, :, 0] - luma) / RED_SCALE + 128)
    fine, coarse = scaled(LUMINANCE, quality), scaled(CHROMINANCE, quality)
    y = plane(y, fine)
    blue, red = ((doubled(plane(halved(c), coarse), y.shape) - 128) for c in (cb, cr))
    green = -(LUMA[0] * RED_SCALE * red + LUMA[2] * BLUE_SCALE * blue) / LUMA[1]
    return to_byte(np.stack([y + RED_SCALE * red, y + green, y + BLUE_SCALE * blue], 2)).astype(np.uint8)
