"""Each image kernel against a version of it that goes pixel by pixel."""

import math

import numpy as np
import pytest

from gridloom.functions import kernels as k

RNG = np.random.default_rng(11)
SIZES = [(23, 31, 3), (9, 14, 3), (17, 8, 1)]


def picture(shape):
    return RNG.integers(0, 256, shape, dtype=np.uint8)


def clipped(x):
    return int(max(0, min(255, math.floor(x))))


def resized(a, height, width):
    h, w, c = a.shape
    out = np.zeros((height, width, c), dtype=np.uint8)
    for y in range(height):
        for x in range(width):
            sy, sx = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            for ch in range(c):
                top = int(a[y0, x0, ch]) * (1 - (sx - x0)) + int(a[y0, x1, ch]) * (sx - x0)
                low = int(a[y1, x0, ch]) * (1 - (sx - x0)) + int(a[y1, x1, ch]) * (sx - x0)
                out[y, x, ch] = clipped(top * (1 - (sy - y0)) + low * (sy - y0) + 0.5)
    return out


def enlarged(a, height, width):
    h, w, _ = a.shape
    return np.array([[a[y * h // height, x * w // width] for x in range(width)] for y in range(height)])


def flattened(a, factor):
    grey = [(299 * int(p[2]) + 587 * int(p[1]) + 114 * int(p[0]) + 500) // 1000 if a.shape[2] == 3 else int(p[0]) for row in a for p in row]
    mean = math.floor(sum(grey) / len(grey) + 0.5)
    return np.array([[[clipped(mean + factor * (int(v) - mean)) for v in p] for p in row] for row in a], dtype=np.uint8)


def dimmed(a, factor):
    return np.array([[[clipped(int(v) * factor) for v in p] for p in row] for row in a], dtype=np.uint8)


def blurred(a, size):
    h, w, c = a.shape
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]

    def at(i, n):
        if n <= size // 2:
            return min(max(i, 0), n - 1)
        return -i if i < 0 else 2 * (n - 1) - i if i >= n else i

    out = np.zeros(a.shape, dtype=np.uint8)
    for y in range(h):
        for x in range(w):
            for ch in range(c):
                v = sum(p * q * int(a[at(y + i - size // 2, h), at(x + j - size // 2, w), ch]) for i, p in enumerate(weights) for j, q in enumerate(weights))
                out[y, x, ch] = clipped(v / sum(weights) ** 2 + 0.5)
    return out


def same(a, b, most=0):
    assert a.shape == b.shape and np.abs(a.astype(int) - b.astype(int)).max() <= most


@pytest.mark.parametrize("shape", SIZES)
def test_sizes(shape):
    a = picture(shape)
    same(k.bilinear(a, 12, 40), resized(a, 12, 40))
    same(k.nearest(a, 12, 40), enlarged(a, 12, 40))
    small = resized(a, max(1, int(shape[0] * 0.3)), max(1, int(shape[1] * 0.3)))
    same(k.mosaic(a, 0.3), enlarged(small, *shape[:2]))
    same(k.rough(a, 13), enlarged(resized(a, 13, 13), *shape[:2]))


@pytest.mark.parametrize("shape", SIZES)
def test_letterbox(shape):
    a, side = picture(shape), 20
    h, w = (max(1, min(side, round(n * side / max(shape[:2])))) for n in shape[:2])
    want = np.zeros((side, side, shape[2]), dtype=np.uint8)
    want[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = resized(a, h, w)
    same(k.letterbox(a, side), want)


@pytest.mark.parametrize("shape", SIZES)
def test_night_and_rain(shape):
    a = picture(shape)
    r = k.draws("x")
    low, flat = r.uniform(0.2, 0.4), r.uniform(0.7, 0.9)
    same(k.night(a, k.draws("x")), flattened(dimmed(a, low), flat))
    r = k.draws("x", "rain")
    want = flattened(dimmed(a, r.uniform(0.5, 0.8)), r.uniform(0.5, 0.8))
    h, w, _ = shape
    many = int(w * h * 0.01)
    x, y = r.integers(0, w, many, endpoint=True), r.integers(0, h, many, endpoint=True)
    length, slant = r.integers(5, 20, many, endpoint=True), r.integers(-2, 2, many, endpoint=True)
    for i in range(many):
        for step in range(length[i] + 1):
            px, py = math.floor(x[i] + slant[i] * step / length[i] + 0.5), y[i] + step
            if 0 <= px < w and py < h:
                want[py, px] = 200
    same(k.rain(a, k.draws("x", "rain")), want)


@pytest.mark.parametrize("shape,size", [(SIZES[0], 5), (SIZES[1], 25), (SIZES[2], 7)])
def test_fog(shape, size):
    a = picture(shape)
    same(k.fog(a, size), blurred(a, size))


@pytest.mark.parametrize("shape,tiles", [((16, 24), 4), ((19, 13), 3)])
def test_equalisation(shape, tiles):
    a = RNG.integers(60, 120, shape, dtype=np.uint8)
    th, tw = -(-shape[0] // tiles), -(-shape[1] // tiles)
    mirrored = lambda i, n: i if i < n else 2 * n - 1 - i
    limit, maps = max(1, int(3.0 * th * tw / 256)), {}
    for i in range(tiles):
        for j in range(tiles):
            counts = [0] * 256
            for y in range(i * th, (i + 1) * th):
                for x in range(j * tw, (j + 1) * tw):
                    counts[a[mirrored(y, shape[0]), mirrored(x, shape[1])]] += 1
            spare, total = sum(max(0, n - limit) for n in counts), 0.0
            for v in range(256):
                total += min(counts[v], limit) + spare / 256
                maps[i, j, v] = total * 255 / (th * tw)
    want = np.zeros(shape)
    for y in range(shape[0]):
        for x in range(shape[1]):
            ty, tx = (min(max((p + 0.5) / n - 0.5, 0), tiles - 1) for p, n in ((y, th), (x, tw)))
            y0, x0 = int(ty), int(tx)
            y1, x1, v = min(y0 + 1, tiles - 1), min(x0 + 1, tiles - 1), int(a[y, x])
            top, low = (maps[row, x0, v] * (1 - (tx - x0)) + maps[row, x1, v] * (tx - x0) for row in (y0, y1))
            want[y, x] = top * (1 - (ty - y0)) + low * (ty - y0)
    assert np.allclose(k.equalised(a, 3.0, tiles), want)
    same(k.clahe(a[:, :, None], 3.0, tiles)[:, :, 0], np.clip(np.floor(want + 0.5), 0, 255))


def test_lab_of_known_colours():
    known = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (0, 0, 255): (53.24, 80.09, 67.20), (255, 0, 0): (32.30, 79.19, -107.86)}  # BGR; white, black, red, blue
    for colour, lab in known.items():
        assert np.allclose(k.bgr_to_lab(np.array([[colour]], dtype=np.uint8))[0, 0], lab, atol=0.05)
