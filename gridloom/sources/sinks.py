"""Writing image tables, annotation documents and image files."""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridloom import tables
from gridloom.sources.paths import located

_PNG = "name string, height int, width int, nChannels int, data binary"


def write_images(images: DataFrame, path: str, by: tuple[str, ...] = ("split", "cls", "variant")) -> None:
    """Append to a table of rasters partitioned by the columns of `by` that it has."""
    images.write.mode("append").partitionBy(*(c for c in by if c in images.columns)).parquet(path)


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row `value`: the document as JSON, for small ones; `write_coco` writes those of any size."""
    parts = {name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in (("images", images), ("annotations", annotations), ("categories", categories))}
    whole = parts["images"].crossJoin(parts["annotations"]).crossJoin(parts["categories"])
    return whole.select(F.to_json(F.struct("images", "annotations", "categories"), {"pretty": "true"}).alias("value"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, block: int = 8 << 20) -> None:
    """The document as one file at `path`, each table in the order of its columns.

    Tasks write the elements, a line each, in sorted ranges; one task, as it is one file, then streams these parts, `block` bytes at a time, into
    a hidden file that takes the place of what was at `path` when it is whole.
    """
    spark = images.sparkSession
    named = {"images": images, "annotations": annotations, "categories": categories}
    staged = {name: tables.new_folder(spark, f"coco-{name}") for name in named}
    for name, df in named.items():
        lines = df.repartitionByRange(*df.columns).sortWithinPartitions(*df.columns).select(F.to_json(F.struct(*df.columns)).alias("value"))
        lines.write.text(staged[name])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, where = located(path)
            folder, _, name = where.rpartition("/")
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/.{name}.part") as out:
                for k, (table, parts) in enumerate(staged.items()):
                    out.write(f"{'{' if not k else ','}\n{json.dumps(table)}: [".encode())
                    first = True
                    for lines in _line_blocks(parts, block):
                        out.write((b"\n" if first else b",\n") + lines.replace(b"\n", b",\n"))
                        first = False
                    out.write(b"]")
                out.write(b"\n}\n")
            fs.move(f"{folder}/.{name}.part", where)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    spark.range(1).coalesce(1).mapInArrow(join, "path string").collect()
    for folder in staged.values():
        tables.delete(spark, folder)


def _line_blocks(folder: str, block: int) -> Iterator[bytes]:
    """Whole lines of the parts of a text table, in order, without the break behind the last."""
    fs, root = located(folder)
    found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("part-"))
    for part in found:
        with fs.open_input_stream(part) as f:
            rest = b""
            while raw := f.read(block):
                raw = rest + raw
                end = raw.rfind(b"\n")
                rest = raw[end + 1 :]
                if end >= 0:
                    yield raw[:end]
            if rest:
                yield rest


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG of a BGR or grey raster."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    pixels = pixels[:, :, 2::-1] if channels >= 3 else pixels[:, :, :1]
    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(pixels))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@dataclass
class _Made(WriterCommitMessage):
    names: list[str]


class _PngWriter(DataSourceWriter):
    """Files are written to a hidden folder of the job, and moved from there when all tasks are done."""

    def __init__(self, options: dict) -> None:
        self.folder, self.job = options["path"].rstrip("/"), f".job-{uuid.uuid4().hex}"
        fs, root = self._where()
        fs.create_dir(f"{root}/{self.job}", recursive=True)  # here and not in tasks, so that none makes it again behind an abort

    def _where(self) -> tuple[pafs.FileSystem, str]:
        return located(self.folder)

    def write(self, iterator: Iterator[Row]) -> _Made:
        fs, root = self._where()
        names = []
        for r in iterator:
            part = f"{root}/{self.job}/.{r.name}.{uuid.uuid4().hex}"  # an attempt that is repeated leaves whole files only
            with fs.open_output_stream(part) as f:
                f.write(png(r.height, r.width, r.nChannels, r.data))
            fs.move(part, f"{root}/{self.job}/{r.name}.png")
            names.append(r.name)
        return _Made(names)

    def commit(self, messages: list[_Made | None]) -> None:
        fs, root = self._where()
        made = {name for m in messages if m is not None for name in m.names}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: fs.move(f"{root}/{self.job}/{name}.png", f"{root}/{name}.png"), made))
        self._clear()

    def abort(self, messages: list[_Made | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove the job's folder, into which tasks that are being killed may still write."""
        fs, root = self._where()
        for wait in (0.1, 0.5, 2.0, 5.0, 0.0):
            try:
                if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
                    fs.delete_dir(f"{root}/{self.job}")
                return
            except OSError:
                if not wait:
                    raise
                time.sleep(wait)


class PngSink(DataSource):
    """Option: path, a folder. Rows: name, height, width, nChannels, data."""

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def schema(self) -> str:
        return _PNG

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PngWriter(self.options)


def export_files(images: DataFrame, folder: str) -> DataFrame:
    """Write each raster as folder/<name>.png from the tasks, and return the manifest (name, path).

    The files appear when all of them are written; a job that fails leaves none, and those of earlier exports as they were. The last moves are
    made by the driver, a name at a time, which names bound in number by what a folder of single files may hold.
    """
    spark = images.sparkSession
    spark.dataSource.register(PngSink)
    rows = tables.written(images.select("name", "height", "width", "nChannels", "data"), "rasters")
    rows.write.format("png_files").mode("append").save(folder)
    return rows.select("name", F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("name"), F.lit(".png")).alias("path"))
