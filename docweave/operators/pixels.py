"""Tensors from pixels: resizing, normalisation, tiling and perspective crops in numpy. Images are (height, width, 3) uint8."""

from __future__ import annotations

import math

import numpy as np

#: Channel statistics of the detector, its stride, and the fixed-point precision of the bicubic filter.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
PRECISION = 22
REC_HEIGHT = 48


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = a * (((x - 5) * x + 8) * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def coefficients(source: int, target: int, kernel=cubic, support: float = 2.0) -> list[tuple[int, np.ndarray]]:
    """First source pixel and fixed-point weights of each target pixel: the kernel widens when shrinking, weights at the edges are renormalised."""
    scale = source / target
    wide = max(1.0, scale)
    out = []
    for i in range(target):
        centre = (i + 0.5) * scale
        lo = max(0, int(centre - support * wide + 0.5))
        hi = min(source, int(centre + support * wide + 0.5))
        w = kernel((np.arange(lo, hi) + 0.5 - centre) / wide)
        w = w / w.sum()
        out.append((lo, np.where(w < 0, np.ceil(w * (1 << PRECISION) - 0.5), np.floor(w * (1 << PRECISION) + 0.5)).astype(np.int64)))
    return out


def _pass(image: np.ndarray, weights: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Along the first axis, rounded to bytes."""
    out = np.empty((len(weights), *image.shape[1:]), np.uint8)
    for i, (lo, w) in enumerate(weights):
        total = np.tensordot(w, image[lo : lo + len(w)].astype(np.int64), axes=1) + (1 << (PRECISION - 1))
        out[i] = np.clip(total >> PRECISION, 0, 255)
    return out


def resize(image: np.ndarray, width: int, height: int, kernel=cubic, support: float = 2.0) -> np.ndarray:
    """Separable, columns first; a side that keeps its size is left alone."""
    if image.shape[1] != width:
        image = _pass(image.transpose(1, 0, 2), coefficients(image.shape[1], width, kernel, support)).transpose(1, 0, 2)
    if image.shape[0] != height:
        image = _pass(image, coefficients(image.shape[0], height, kernel, support))
    return image


def detector_tensor(image: np.ndarray, width: int, height: int, canvas: tuple[int, int]) -> np.ndarray:
    """(3, H, W) float32, BGR, normalised; what lies beyond the image is black before normalisation."""
    scaled = resize(image, width, height, triangle, 1.0)[:, :, ::-1]
    full = np.zeros((canvas[1], canvas[0], 3), np.float32)
    full[:height, :width] = scaled / np.float32(255)
    return ((full - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1)


def recognition_tensor(image: np.ndarray, canvas: int) -> np.ndarray:
    """(3, 48, canvas) float32, BGR, within -1 and 1; zeros to the right."""
    width = min(canvas, max(1, math.ceil(REC_HEIGHT * image.shape[1] / image.shape[0])))
    out = np.zeros((3, REC_HEIGHT, canvas), np.float32)
    scaled = resize(image, width, REC_HEIGHT, triangle, 1.0)[:, :, ::-1]
    out[:, :, :width] = (scaled.astype(np.float32) / np.float32(127.5) - 1).transpose(2, 0, 1)
    return out


def table_tensor(image: np.ndarray, side: int = 488) -> np.ndarray:
    """(3, side, side) float32, RGB, normalised; zeros beyond the image."""
    scale = side / max(image.shape[:2])
    w, h = max(1, round(image.shape[1] * scale)), max(1, round(image.shape[0] * scale))
    scaled = resize(image, w, h, triangle, 1.0).astype(np.float32) / np.float32(255)
    out = np.zeros((side, side, 3), np.float32)
    out[:h, :w] = (scaled - np.array(MEAN, np.float32)) / np.array(STD, np.float32)
    return out.transpose(2, 0, 1)


def seal_tensor(image: np.ndarray, side: int = 640) -> np.ndarray:
    """(3, side, side) float32, RGB within 0 and 1, stretched to the square."""
    return (resize(image, side, side).astype(np.float32) / np.float32(255)).transpose(2, 0, 1)


def square(image: np.ndarray, fill: int = 127) -> np.ndarray:
    """Padded to a square, the image in the middle."""
    h, w = image.shape[:2]
    side = max(h, w)
    out = np.full((side, side, 3), fill, np.uint8)
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = image
    return out


def tiles(image: np.ndarray, cols: int, rows: int, side: int) -> list[np.ndarray]:
    """Row by row, of the image stretched to the grid."""
    scaled = resize(image, cols * side, rows * side)
    return [scaled[r * side : (r + 1) * side, c * side : (c + 1) * side] for r in range(rows) for c in range(cols)]


def perspective(quad: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The 3x3 map from a crop's pixels to the quad's."""
    a, b = [], []
    for (x, y), (u, v) in zip(((0, 0), (width, 0), (width, height), (0, height)), quad, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1).reshape(3, 3)


def crop(image: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The quad straightened by bicubic sampling with white outside; tall crops are turned by 270 degrees."""
    side = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    width = int(max(side(quad[0], quad[1]), side(quad[3], quad[2])))
    height = int(max(side(quad[0], quad[3]), side(quad[1], quad[2])))
    if width < 1 or height < 1:
        raise ValueError("crop_invalid")
    m = perspective(quad, width, height)
    y, x = np.mgrid[0:height, 0:width]
    den = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    sx, sy = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / den, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / den
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((height, width, 3))
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            px, py = x0 + dx, y0 + dy
            inside = (px >= 0) & (px < image.shape[1]) & (py >= 0) & (py < image.shape[0])
            value = np.where(inside[:, :, None], image[py.clip(0, image.shape[0] - 1), px.clip(0, image.shape[1] - 1)], 255)
            out += value * (cubic(sx - px, -0.75) * cubic(sy - py, -0.75))[:, :, None]
    straight = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return np.rot90(straight, 3) if height >= 1.5 * width else straight
