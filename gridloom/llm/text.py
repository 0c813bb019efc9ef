"""Word and n-gram hashing over Arrow text columns, vectorised in numpy.

Texts are handled as the UTF-8 bytes of an Arrow column, in chunks of bounded size, so a
task holds a few arrays of `CHUNK` bytes (or of one document, if that is longer) at a time.

A hash is that of a polynomial with the sequence as coefficients: its values at two random points
modulo the prime 2**31 - 1, from prefix sums, finished by an avalanche step. Two unlike sequences of n items
share it for (n / 2**31)**2 of all pairs of points at most, whatever the sequences are (modulo a power of two
there are sequences that collide at every point). Equal sequences always get equal hashes. Operators
that decide across the corpus on hashes alone say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
PRIME = (1 << 31) - 1
_LOW, _HALF = np.uint64(PRIME), np.uint64(31)


class ByteHash(NamedTuple):
    """Two points, and what each byte counts at either."""

    points: tuple[int, int]
    values: np.ndarray

    @classmethod
    def random(cls, seed: int) -> ByteHash:
        r = np.random.default_rng(seed)
        return cls(tuple(r.integers(1 << 20, PRIME, 2).tolist()), r.integers(1, PRIME, (2, 256), dtype=np.uint64))

    def lowered(self) -> ByteHash:
        """The same with A-Z read as a-z."""
        values = self.values.copy()
        values[:, 0x41:0x5B] = values[:, 0x61:0x7B]
        return self._replace(values=values)


BYTES = ByteHash.random(5_150_211)
LOWER_BYTES = BYTES.lowered()
#: Other points and values, for a second hash that does not follow from the first.
SECOND = ByteHash.random(7_300_427)
#: The points of runs of items.
_RUN_POINTS = ByteHash.random(9_120_077).points

#: ASCII blanks that separate words.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[list(BLANKS)] = False
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (and some more) powers of the point and of its inverse modulo PRIME."""
    have = _powers.get(point)
    if have is not None and len(have[0]) >= n:
        return have
    size = 1 << max(10, int(n).bit_length())
    both = []
    for base in (point, pow(point, -1, PRIME)):
        p = np.ones(size, dtype=np.uint64)
        k = 1
        while k < size:
            p[k : 2 * k] = _reduced(p[:k] * np.uint64(pow(base, k, PRIME)))
            k *= 2
        both.append(p.astype(np.uint32))
    if size <= 2 * CHUNK:  # those of a longer text are not worth keeping
        _powers[point] = (both[0], both[1])
    return both[0], both[1]


def _folded(x: np.ndarray) -> np.ndarray:
    """x in place, under 2**33 or (from under 2**62) 2**32, and the same modulo PRIME."""
    high = x >> _HALF
    x &= _LOW
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x in place, modulo PRIME."""
    x = _folded(_folded(x))
    x[x >= _LOW] -= _LOW
    return x


def _sums(coefficients: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of coefficients (used up) times powers; of under 2**32 items, as they are not reduced."""
    coefficients *= up[: len(coefficients)]
    sums = np.zeros(len(coefficients) + 1, dtype=np.uint64)
    np.cumsum(_folded(coefficients), out=sums[1:])
    return sums


def _joined(two: list[np.ndarray], salt: int = 0) -> np.ndarray:
    return mix((two[0] << np.uint64(32)) | two[1], salt)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = h ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 text bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunked(bounds: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` bytes, or of one longer text."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Byte spans of the words of some consecutive texts; text d has words first[d]..first[d+1]-1."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = np.empty(n + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = keep[data]
        step = np.diff(inside)  # 1: a word starts here, -1: one ended before here
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        inner = bounds[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)] if n else inner
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, bounds)
        self.first[-1] = len(starts)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def room(self) -> np.ndarray:
        """How many words its text has from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self, table: ByteHash = BYTES) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, table)


class Spans:
    """Hashes of spans of the same bytes: the prefix sums are made once."""

    def __init__(self, data: np.ndarray, table: ByteHash = BYTES) -> None:
        self.two = []
        for point, values in zip(table.points, table.values, strict=True):
            up, down = powers(point, len(data) + 1)
            self.two.append((_sums(np.take(values, data), up), down))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[starts[i]:ends[i]] for each i."""
        return _joined([_reduced(_reduced(sums[ends] - sums[starts]) * down[starts]) for sums, down in self.two])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: ByteHash = BYTES) -> np.ndarray:
    """A 64-bit hash of data[starts[i]:ends[i]] for each i."""
    return Spans(data, table).hashes(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray, table: ByteHash = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text, taken `CHUNK` bytes at a time."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunked(bounds):
        w = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], keep)
        hashes.append(w.hashes(table))
        counts.append(w.counts)
    return np.concatenate(hashes), np.concatenate(counts)


def run_hashes(items: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive items (64-bit hashes); whether they are of one text is for the caller."""
    many = len(items) - n + 1
    if many <= 0:
        return np.zeros(0, dtype=np.uint64)
    two = []
    for point, part in zip(_RUN_POINTS, (items >> np.uint64(33), items & _LOW), strict=True):
        up, down = powers(point, len(items))
        sums = _sums(part, up)
        two.append(_reduced(_reduced(sums[n:] - sums[:-n]) * down[:many]))
    return _joined(two, salt)


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over every `width` consecutive values, in log2(width) passes."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return out if have == width else op(out[: len(values) - width + 1], out[width - have :])


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if len(values):
        begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        yield from zip(values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over first[d]..first[d+1]-1 for each text d."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
