"""Zip archives as a data source: a task reads a range of entries by their place in the file, never the archive.

Planning reads each archive's central directory (about a hundred bytes an entry); what is asked for is cut into
ranges of about `partition_bytes` of compressed content, in the order of the file. A task seeks to its entries and inflates one at a time, so its
memory is that of its largest entry. Entries may be stored or compressed in any way that Python knows; their checksums are
verified; encrypted ones are an error.
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.paths import listed, located

_SCHEMA = "archive string, entry string, size long, content binary"


@dataclass
class _Entry:
    name: str
    at: int
    kind: int
    crc: int
    packed: int
    size: int
    flags: int


@dataclass
class _Range(InputPartition):
    archive: str
    entries: list[_Entry]


def _content(f: pa.NativeFile, e: _Entry) -> bytes:
    """The entry's bytes, inflated; the header before them has a name and extra fields of its own lengths."""
    if e.flags & 1:
        raise ValueError(f"entry {e.name!r} is encrypted")
    f.seek(e.at)
    header = f.read(30)
    if header[:4] != b"PK\3\4":
        raise ValueError(f"no entry {e.name!r} at byte {e.at}")
    name, extra = struct.unpack("<HH", header[26:30])
    f.seek(e.at + 30 + name + extra)
    info = zipfile.ZipInfo(e.name)
    info.compress_type, info.CRC, info.compress_size, info.file_size = e.kind, e.crc, e.packed, e.size
    return zipfile.ZipExtFile(f, "r", info).read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.archives, self.wanted, self.limit = json.loads(options["archives"]), options.get("wanted", ".*"), int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> list[_Range]:
        out: list[_Range] = []
        for name in self.archives:
            fs, where = located(name)
            with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z:
                infos = sorted((i for i in z.infolist() if not i.is_dir() and re.search(self.wanted, i.filename)), key=lambda i: i.header_offset)
            held, size = [], 0
            for i in infos:
                if held and size + i.compress_size > self.limit:
                    out.append(_Range(name, held))
                    held, size = [], 0
                held.append(_Entry(i.filename, i.header_offset, i.compress_type, i.CRC, i.compress_size, i.file_size, i.flag_bits))
                size += i.compress_size
            if held:
                out.append(_Range(name, held))
        return out or [_Range("", [])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.entries:
            return
        fs, where = located(partition.archive)
        with fs.open_input_file(where) as f:
            for e in partition.entries:
                columns = [pa.array([partition.archive]), pa.array([e.name]), pa.array([e.size], pa.int64()), pa.array([_content(f, e)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "entry", "size", "content"])


class ZipSource(DataSource):
    """Options: archives (their paths, as JSON), wanted (a pattern of entry names), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def entries(spark: SparkSession, path: str, wanted: str = ".*", partition_bytes: int = 64 << 20) -> DataFrame:
    """archive, entry, size, content for each file whose name matches, in the archives that path names: one, those of a pattern, or those of a folder."""
    spark.dataSource.register(ZipSource)
    found = json.dumps(listed(spark, path, ".zip"))
    return spark.read.format("zip_entries").option("archives", found).option("wanted", wanted).option("partition_bytes", partition_bytes).load()
