"""Image kernels on uint8 arrays (height, width, channels), for use inside Arrow batches.

Resizing is bilinear with half-pixel centres; values are rounded and clipped. Draws come from a
generator seeded by image id and variant, so a rerun makes the same picture.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.functions.pixels import DEVIATION, GREY, MEAN


def clipped(a: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(np.floor(a), 0), 255).astype(np.uint8)


def rounded(a: np.ndarray) -> np.ndarray:
    return clipped(a + 0.5)


def draws(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(":".join(map(str, key)).encode()).digest()[:8], "big"))


def within(a: np.ndarray) -> np.ndarray:
    """Rounded values of 0..255, which need no clipping; overwrites them."""
    a += 0.5
    return a.astype(np.uint8)


def by_length(f: Callable) -> Callable:
    """What depends on the length of a side only is kept for the last 256 lengths; beyond 1,024 it is large, and cheap beside the picture's own work."""
    kept = lru_cache(256)(f)
    return lambda n, m, *more: (kept if max(n, m) <= 1024 else f)(n, m, *more)


@by_length
def _between(old: int, new: int, wanted: bytes | None, channels: int) -> tuple[np.ndarray, ...]:
    """For places 0..new-1, or those wanted, of `old` resized to `new`: the old places in use; of these the one before and the one after, and their shares, each for all channels."""
    at = np.arange(new) if wanted is None else np.frombuffer(wanted, dtype=np.int64)
    at = np.clip((at + 0.5) * old / new - 0.5, 0, old - 1)
    k0 = np.floor(at).astype(int)
    used, ends = np.unique([k0, np.minimum(k0 + 1, old - 1)], return_inverse=True)
    k0, k1 = (ends.reshape(2, -1, 1) * channels + np.arange(channels)).reshape(2, -1)
    share = np.repeat(at - np.floor(at), channels)
    return used, k0, k1, 1 - share, share


def bilinear(image: np.ndarray, height: int, width: int, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> np.ndarray:
    """Resized; of the new picture only these rows and columns, if given."""
    h, w, c = image.shape
    used, y0, y1, ly, fy = _between(h, height, None if rows is None else rows.astype(np.int64).tobytes(), 1)
    wide, x0, x1, lx, fx = _between(w, width, None if cols is None else cols.astype(np.int64).tobytes(), c)
    f = image.take(used, axis=0)
    f = (f if len(wide) == w else f.take(wide, axis=1)).reshape(len(used), -1).astype(np.float64)
    across, right = f.take(x0, axis=1), f.take(x1, axis=1)
    across *= lx
    right *= fx
    across += right
    out, low = across.take(y0, axis=0), across.take(y1, axis=0)
    out *= ly[:, None]
    low *= fy[:, None]
    out += low
    return within(out).reshape(len(y0), -1, c)


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image.take(np.arange(width) * w // width, axis=1).take(np.arange(height) * h // height, axis=0)


#: Every value of a byte: what depends on one value only is made for these and looked up.
BYTES = np.arange(256, dtype=np.uint8)


def looked_up(image: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytearray(image.tobytes().translate(table.tobytes())), dtype=np.uint8).reshape(image.shape)


def brightness(image: np.ndarray, factor: float) -> np.ndarray:
    return looked_up(image, clipped(BYTES * factor))


_BGR_GREY = np.array(GREY[::-1], dtype=np.float32)


def grey(image: np.ndarray) -> np.ndarray:
    """Grey values of a BGR or one-channel image."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.int32)
    out = (image[:, :, :3].astype(np.float32) @ _BGR_GREY).astype(np.int32)  # whole numbers of under 2 ** 24: exact
    out += 500
    out //= 1000
    return out


def contrast(image: np.ndarray, factor: float) -> np.ndarray:
    values = grey(image)
    mean = np.floor(values.sum(dtype=np.int64) / values.size + 0.5)
    return looked_up(image, clipped(mean + factor * (BYTES - mean)))


def night(image: np.ndarray, r: np.random.Generator) -> np.ndarray:
    return contrast(brightness(image, r.uniform(0.2, 0.4)), r.uniform(0.7, 0.9))


def rain(image: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Dim and flat, with a light grey streak for every hundred pixels; streaks may begin off the canvas."""
    out = contrast(brightness(image, r.uniform(0.5, 0.8)), r.uniform(0.5, 0.8))
    h, w = out.shape[:2]
    many = int(w * h * 0.01)
    x, y = r.integers(0, w, many, endpoint=True), r.integers(0, h, many, endpoint=True)
    length, slant = r.integers(5, 20, many, endpoint=True), r.integers(-2, 2, many, endpoint=True)
    step = np.arange(21)[None, :]
    on = step <= length[:, None]
    ys = y[:, None] + step
    xs = np.floor(x[:, None] + slant[:, None] * step / length[:, None] + 0.5).astype(int)
    on &= (ys < h) & (xs >= 0) & (xs < w)
    out.reshape(h * w, -1)[(ys * w + xs)[on]] = 200
    return out


def mosaic(image: np.ndarray, share: float = 0.1) -> np.ndarray:
    h, w = image.shape[:2]
    return nearest(bilinear(image, max(1, int(h * share)), max(1, int(w * share))), h, w)


def rough(image: np.ndarray, side: int = 130) -> np.ndarray:
    """Resized to side x side and back by the nearest pixel; only what that picks is made."""
    h, w = image.shape[:2]
    return bilinear(image, side, side, np.arange(h) * side // h, np.arange(w) * side // w)


#: Lines that are blurred by one product.
_LINES = 64


@by_length
def _blur(n: int, size: int) -> list[tuple[int, int, np.ndarray]]:
    """For each stretch of `_LINES` of n lines: the first line that it takes from, the last and one, and the weights of these."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    pad, out = size // 2, []
    source = np.pad(np.arange(n), pad, mode="reflect" if n > pad else "edge")
    for start in range(0, n, _LINES):
        of = source[start : start + min(_LINES, n - start) + size - 1]
        inner = pad <= start and start + _LINES + pad <= n
        if not inner or not out or out[-1][2].shape != (_LINES, _LINES + size - 1):  # inner ones are all alike
            band = np.zeros((len(of) - size + 1, of.max() + 1 - of.min()))
            for k, line in enumerate(band):
                np.add.at(line, of[k : k + size] - of.min(), weights)
        out.append((int(of.min()), int(of.max()) + 1, band))
    return out


def fog(image: np.ndarray, size: int = 15) -> np.ndarray:
    """Gaussian blur; the deviation follows from the odd size, edges are mirrored."""
    if size % 2 == 0:
        raise ValueError("size must be odd")
    h, w, c = image.shape
    f, down, across = planar(image).astype(np.float64), np.empty((c, h, w)), np.empty((c * h, w))
    for start, (first, last, band) in zip(range(0, h, _LINES), _blur(h, size), strict=True):
        down[:, start : start + _LINES] = band @ f[:, first:last]
    down = down.reshape(c * h, w)
    for start, (first, last, band) in zip(range(0, w, _LINES), _blur(w, size), strict=True):
        across[:, start : start + _LINES] = down[:, first:last] @ band.T
    return interleaved(within(across).reshape(c, h, w))


def planar(image: np.ndarray) -> np.ndarray:
    """(height, width, channels) as (channels, height, width)."""
    return np.ascontiguousarray(image.transpose(2, 0, 1))


def interleaved(planes: np.ndarray) -> np.ndarray:
    """(channels, height, width) as (height, width, channels)."""
    out = np.empty((*planes.shape[1:], planes.shape[0]), dtype=planes.dtype)
    for k, plane in enumerate(planes):
        out[:, :, k] = plane
    return out


# sRGB (linear) to XYZ, and the white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_TO_XYZ, _FROM_XYZ = _XYZ / _WHITE[:, None], np.linalg.inv(_XYZ) * _WHITE
_LINEAR = np.where(BYTES / 255.0 <= 0.04045, BYTES / 255.0 / 12.92, ((BYTES / 255.0 + 0.055) / 1.055) ** 2.4)


def _curve(linear: np.ndarray) -> np.ndarray:
    return rounded(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055) * 255)


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """For each of 4096 cells of 0..1 and 1 itself: the byte of its begin, and where in it the next byte begins. No cell has two such places, as a byte spans more than 1 / 3295."""
    low, high = np.zeros(255, dtype=np.int64), np.full(255, np.float64(1).view(np.int64))  # doubles are ordered as their bits
    while (high - low > 1).any():
        middle = (low + high) // 2
        up = _curve(middle.view(np.float64)) > BYTES[:255]
        low, high = np.where(up, low, middle), np.where(up, middle, high)
    begin = high.view(np.float64)
    cells = np.arange(4097) / 4096
    byte = np.searchsorted(begin, cells, side="right")
    return byte.astype(np.uint8), np.append(begin, 2.0)[byte]


_BYTE, _NEXT = _steps()


def gamma(linear: np.ndarray) -> np.ndarray:
    """Bytes of linear light of 0..1, as `_curve` rounds them."""
    cell = (linear * 4096).astype(np.int64)
    out = _BYTE.take(cell)
    out += linear >= _NEXT.take(cell)
    return out


def _roots(t: np.ndarray) -> np.ndarray:
    """Cube roots of what is over 0.008856, and the line that goes on below: single precision, and a step of Newton's from there."""
    above = np.maximum(t, 0.008856)
    y = np.log(above.astype(np.float32))
    y *= np.float32(1 / 3)
    y = np.exp(y).astype(np.float64)
    above /= y * y
    y *= 2
    y += above
    y *= 1 / 3
    low = t <= 0.008856
    if low.any():
        y[low] = 7.787 * t[low] + 16 / 116
    return y


def _planes(image: np.ndarray) -> np.ndarray:
    """What Lab is made of, (3, pixels): the roots of X, Y and Z over those of white."""
    return _roots(_TO_XYZ @ _LINEAR.take(planar(image[:, :, 2::-1]).reshape(3, -1)))


def bgr_to_lab(image: np.ndarray) -> np.ndarray:
    """L 0..100, a and b, as floats."""
    x, y, z = _planes(image).reshape(3, *image.shape[:2])
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)


def _bgr(f: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture of such planes."""
    t = f * f
    t *= f
    low = f <= 6 / 29
    if low.any():
        t[low] = (f[low] - 16 / 116) / 7.787
    linear = _FROM_XYZ[::-1] @ t
    np.maximum(linear, 0, out=linear)
    np.minimum(linear, 1, out=linear)
    return interleaved(gamma(linear).reshape(3, height, width))


def lab_to_bgr(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    return _bgr(np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200]).reshape(3, -1), *lab.shape[:2])


@by_length
def _tiles(n: int, tiles: int) -> tuple:
    """A tile's length; the places of all tiles, mirrored beyond n, and their tiles; for each place the tile before and that after, and the share of the latter."""
    size = -(-n // tiles)
    at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, tiles - 1)
    k0 = np.floor(at).astype(int)
    return size, np.pad(np.arange(n), (0, size * tiles - n), mode="symmetric"), np.arange(size * tiles) // size, k0, np.minimum(k0 + 1, tiles - 1), at - k0


def equalised(values: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of 0..255 values, blended between tile centres."""
    th, rows, ty, y0, y1, fy = _tiles(values.shape[0], tiles)
    tw, cols, tx, x0, x1, fx = _tiles(values.shape[1], tiles)
    area = th * tw
    limit = max(1, int(clip * area / 256))
    values = values.astype(np.int64)
    place = values.take(rows, axis=0).take(cols, axis=1)
    place += (ty * (tiles * 256))[:, None]
    place += tx * 256
    counts = np.bincount(place.ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    np.minimum(counts, limit, out=counts)
    sums = counts.cumsum(axis=1)
    maps = np.arange(1.0, 257.0) * ((area - sums[:, -1:]) / 256)  # what the limit cuts off goes to all values
    maps += sums
    maps *= 255
    maps /= area
    flat, fy, ly, lx = maps.ravel(), fy[:, None], 1 - fy[:, None], 1 - fx
    left, right = values + x0 * 256, values + x1 * 256

    def row(y: np.ndarray) -> np.ndarray:
        base = (y * (tiles * 256))[:, None]
        before, after = flat.take(left + base), flat.take(right + base)
        before *= lx
        after *= fx
        before += after
        return before

    out, low = row(y0), row(y1)
    out *= ly
    low *= fy
    out += low
    return out


def clahe(image: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Lightness equalised, colours kept."""
    if image.shape[2] < 3:
        return rounded(equalised(image[:, :, 0], clip, tiles))[:, :, None]
    f, (h, w) = _planes(image), image.shape[:2]
    lightness = equalised(rounded((116 * f[1] - 16) * 2.55).reshape(h, w), clip, tiles)
    f += (lightness.ravel() / 2.55 + 16) / 116 - f[1]
    return _bgr(f, h, w)


def letterbox(image: np.ndarray, side: int = 224) -> np.ndarray:
    """Scaled to fit and centred on black."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    nh, nw = max(1, min(side, round(h * scale))), max(1, min(side, round(w * scale)))
    out = np.zeros((side, side, image.shape[2]), dtype=np.uint8)
    top, left = (side - nh) // 2, (side - nw) // 2
    out[top : top + nh, left : left + nw] = bilinear(image, nh, nw)
    return out


def stretched(image: np.ndarray, side: int = 224) -> np.ndarray:
    return bilinear(image, side, side)


def three_channels(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def model_input(image: np.ndarray, side: int = 224, fit: str = "letterbox", flip: bool = False) -> np.ndarray:
    """float32 (3, side, side), red first, normalised."""
    a = (letterbox if fit == "letterbox" else stretched)(three_channels(image), side)[:, :, ::-1]
    a = a[:, ::-1] if flip else a
    return np.ascontiguousarray(((a / 255.0 - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1), dtype=np.float32)


def cut(image: np.ndarray, rows: int = 3, cols: int = 3) -> list[np.ndarray]:
    """Tiles along rows; what is left at the right and below is in none."""
    th, tw = image.shape[0] // rows, image.shape[1] // cols
    return [image[i * th : (i + 1) * th, j * tw : (j + 1) * tw] for i in range(rows) for j in range(cols)]


#: name -> kernel(image, image id)
VARIANT_KERNELS: dict[str, Callable[[np.ndarray, object], np.ndarray]] = {
    "original": lambda a, i: a,
    "night": lambda a, i: night(a, draws(i, "night")),
    "rain": lambda a, i: rain(a, draws(i, "rain")),
    "mosaic": lambda a, i: mosaic(a, 0.08),
    "fog": lambda a, i: fog(a, 25),
    "rough": lambda a, i: rough(a),
    "recovered": lambda a, i: clahe(a),
}


#: Images whose results go on together.
TOGETHER = 16
_SHAPE = [(n, T.IntegerType()) for n in ("height", "width", "nChannels")]
_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


def _raster(batch: pa.RecordBatch, row: int) -> np.ndarray:
    data, *shape = (batch.column(c)[row] for c in ("data", "height", "width", "nChannels"))
    return np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape([n.as_py() for n in shape])


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Pictures are copied once, into a buffer of all of them."""
    if kind != pa.binary():
        return pa.array(values, kind)
    ends = np.cumsum([0, *(0 if a is None else a.size for a in values)])
    if ends[-1] > np.iinfo(np.int32).max or any(a is None for a in values):
        return pa.array([None if a is None else a.tobytes() for a in values], kind)
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(map(np.ascontiguousarray, values)))])


def _made(images: DataFrame, more: T.StructType, rows: Callable[[pa.RecordBatch, int], list[tuple]]) -> DataFrame:
    """A row for each tuple that `rows` gives for an image of a batch: the image's other columns, and those of more."""
    kept = [f for f in images.schema.fields if f.name not in ("height", "width", "nChannels", "data")]
    names = [f.name for f in (*kept, *more.fields)]
    kinds = [_ARROW[type(f.dataType)] for f in more.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                out = [(k, *row) for k in range(start, min(start + TOGETHER, batch.num_rows)) for row in rows(batch, k)]
                of, *columns = zip(*out, strict=True) if out else [()] * (len(kinds) + 1)
                own = [batch.column(f.name).take(pa.array(of, pa.int64())) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *(_column(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return images.mapInArrow(run, T.StructType([*kept, *more.fields]))


def with_variants(images: DataFrame, variants: tuple[str, ...] = ("original", "night", "rain"), id_col: str = "image_id") -> DataFrame:
    """A raster row for each image and variant; an image's variants come together or, on an error, not at all (see error)."""

    def rows(batch: pa.RecordBatch, k: int) -> list[tuple]:
        try:
            image, key = _raster(batch, k), batch.column(id_col)[k].as_py()
            return [(v, *a.shape, a, None) for v, a in ((v, VARIANT_KERNELS[v](image, key)) for v in variants)]
        except Exception as e:  # the row carries the error
            return [(None, None, None, None, None, f"{type(e).__name__}: {e}")]

    return _made(images, _fields(("variant", T.StringType()), *_SHAPE, ("data", T.BinaryType()), ("error", T.StringType())), rows)


def tiled(images: DataFrame, rows: int = 3, cols: int = 3) -> DataFrame:
    """A raster row for each tile, with index; images smaller than the grid have none."""

    def of(batch: pa.RecordBatch, k: int) -> list[tuple]:
        return [(i, *a.shape, a) for i, a in enumerate(cut(_raster(batch, k), rows, cols)) if a.size]

    return _made(images, _fields(("index", T.IntegerType()), *_SHAPE, ("data", T.BinaryType())), of)
