"""The elements of large JSON arrays as a data source: one document is read by many tasks.

A first pass over the document's bytes, in blocks, finds where strings are, how deep each bracket is and which commas stand between elements of an
array: of the document itself, or of the arrays that are fields of its one object. It keeps a cut about every `split_bytes`, at
such a comma, with how many elements are before. A task then reads the bytes between two cuts, splits them in the same way and gives each
element's text with its place; parsing is left to Spark.

Documents are UTF-8. What is no JSON is an error where brackets do not match, and else for the parser to find.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.paths import located

BLOCK = 8 << 20
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)
_SCHEMA = "key string, pos long, value string"


@dataclass
class Stretch(InputPartition):
    """Elements of the array `key` (null: of the document) between two cuts; the first is number `pos`."""

    key: str | None
    start: int
    end: int
    pos: int


class _Structure:
    """Commas and brackets outside of strings, block by block, with the depth behind each."""

    def __init__(self) -> None:
        self.depth, self.inside = 0, False

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, bytes and depths; a block does not end in a backslash."""
        quote = data == 0x22
        slash = np.flatnonzero(data == 0x5C)
        if len(slash):
            fresh = np.ones(len(slash), dtype=bool)
            fresh[1:] = slash[1:] != slash[:-1] + 1
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(slash)))
            quote[slash[begin][size % 2 == 1] + size[size % 2 == 1]] = False  # behind an odd run of backslashes
        within = (np.cumsum(quote) + self.inside) % 2 == 1
        at = np.flatnonzero(((data == 0x2C) | ((data | 0x20) == 0x7B) | ((data | 0x20) == 0x7D)) & ~within)
        kind = data[at]
        depth = self.depth + np.cumsum(np.where(kind == 0x2C, 0, np.where((kind | 0x20) == 0x7B, 1, -1)))
        if len(within):
            self.inside = bool(within[-1])
        if len(depth):
            self.depth = int(depth[-1])
        return at, kind, depth


def _blocks(f: pa.NativeFile, block: int) -> Iterator[np.ndarray]:
    while raw := f.read(block):
        while raw.endswith(b"\\") and (more := f.read(1)):
            raw += more
        yield np.frombuffer(raw, dtype=np.uint8)


def stretches(path: str, split_bytes: int = 32 << 20, block: int = BLOCK) -> list[Stretch]:
    """Where tasks can begin and end; a stretch for each array at least."""
    fs, where = located(path)
    out: list[Stretch] = []
    structure, base, level, tail = _Structure(), 0, 0, b""
    start: int | None = None  # of the stretch that is open, in the array `key`; pos: of its first element; passed: commas since
    key, pos, passed = None, 0, 0
    with fs.open_input_file(where) as f:
        for data in _blocks(f, block):
            at, kind, depth = structure.of(data)
            if not level and len(at):
                level = 1 if kind[0] == 0x5B else 2
            edges = np.flatnonzero(((kind == 0x5B) & (depth == level)) | ((kind == 0x5D) & (depth == level - 1)))
            commas = at[(kind == 0x2C) & (depth == level)]
            here = 0
            for edge in [*edges.tolist(), None]:
                until = int(at[edge]) if edge is not None else len(data)
                if start is not None:
                    mine = commas[np.searchsorted(commas, here) : np.searchsorted(commas, until)]
                    k = 0
                    while (cut := max(k, int(np.searchsorted(mine, start + split_bytes - base)))) < len(mine):
                        passed += cut + 1 - k
                        out.append(Stretch(key, start, base + int(mine[cut]), pos))
                        start, pos, passed, k = base + int(mine[cut]) + 1, pos + passed, 0, cut + 1
                    passed += len(mine) - k
                if edge is None:
                    break
                if kind[edge] == 0x5B:
                    before = tail + data[max(0, until - 4096) : until].tobytes()
                    named = _KEY.search(before) if level == 2 else None
                    start, pos, passed, key = base + until + 1, 0, 0, json.loads(named[1]) if named else None
                elif start is not None:
                    out.append(Stretch(key, start, base + until, pos))
                    start = None
                here = until + 1
            base += len(data)
            tail = (tail + data[-4096:].tobytes())[-4096:]
    if structure.depth or structure.inside:
        raise ValueError(f"{path} ends within a bracket or string")
    return out


def pieces(raw: bytes) -> Iterator[bytes]:
    """The elements between two cuts."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at, kind, depth = _Structure().of(data)
    cuts = at[(kind == 0x2C) & (depth == 0)].tolist()
    if not cuts and not raw.strip():
        return
    for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(raw)], strict=True):
        yield raw[i:j].strip()


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.found = options["path"], options["stretches"]

    def partitions(self) -> list[Stretch]:
        return [Stretch(**s) for s in json.loads(self.found)] or [Stretch(None, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, where = located(self.path)
        with fs.open_input_file(where) as f:
            raw = f.read_at(partition.end - partition.start, partition.start)
        values = list(pieces(raw))
        for i in range(0, len(values), 10_000):
            some = values[i : i + 10_000]
            places = pa.array(np.arange(len(some)) + partition.pos + i)
            yield pa.RecordBatch.from_arrays([pa.array([partition.key] * len(some), pa.string()), places, pa.array(some, pa.binary()).cast(pa.string())], names=["key", "pos", "value"])


class ElementSource(DataSource):
    """Options: path and stretches."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def elements(spark: SparkSession, path: str, found: list[Stretch]) -> DataFrame:
    """key, pos and value (JSON) of each element in these stretches."""
    spark.dataSource.register(ElementSource)
    return spark.read.format("json_elements").option("stretches", json.dumps([asdict(s) for s in found])).load(path)
