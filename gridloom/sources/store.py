"""Fetched content that is kept: a table of contents by the hash of their URL.

Tasks write what they have fetched in files of about `part_bytes`, each under a temporary name and then renamed, so a job that is stopped
keeps what it had, and no reader sees half a file. What the store has is never fetched again; failures are not stored, so the next run
tries these only. A task that runs again may store a URL twice; readers take one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import tables
from gridloom.sources.paths import located

_STORED = "url_key string, url string, content binary"
_COLUMNS = pa.schema([("url_key", pa.string()), ("url", pa.string()), ("content", pa.binary())])


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """url_key, url and content of all that the store has, each once."""
    fs, root = located(folder)
    fs.create_dir(root, recursive=True)
    return spark.read.schema(_STORED).option("pathGlobFilter", "part-*.parquet").parquet(folder).dropDuplicates(["url_key"])


def _put(fs: pafs.FileSystem, root: str, held: list[tuple[str, str, bytes]]) -> None:
    name = uuid.uuid4().hex
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS)
    with fs.open_output_stream(f"{root}/.{name}.part") as f:
        pq.write_table(table, f, compression="zstd")
    fs.move(f"{root}/.{name}.part", f"{root}/part-{name}.parquet")


def fetched_once(rows: DataFrame, url: str, transport: Callable[[str], bytes], folder: str, tasks: int | None = None, part_bytes: int = 32 << 20) -> DataFrame:
    """rows with content and error; one of both is null. Only URLs that the store in `folder` does not have are fetched, each once.

    tasks: how many fetch at the same time, at most (default: as many as the session likes).
    """
    spark = rows.sparkSession
    key = F.sha2(F.col(url), 256)
    wanted = rows.select(F.col(url).alias("url"), key.alias("url_key")).filter("url is not null").distinct()
    missing = wanted.join(stored(spark, folder).select("url_key"), "url_key", "left_anti")
    missing = missing.repartition(tasks or spark.sparkContext.defaultParallelism, "url_key")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = located(folder)
        held: list[tuple[str, str, bytes]] = []
        failed: list[tuple[str, str]] = []
        for part in parts:
            for name, address in zip(part["url_key"], part["url"], strict=True):
                try:
                    held.append((name, address, transport(address)))
                except Exception as e:  # the row carries the error, the job goes on
                    failed.append((name, f"{type(e).__name__}: {e}"))
                if sum(len(h[2]) for h in held) >= part_bytes:
                    _put(fs, root, held)
                    held = []
        if held:
            _put(fs, root, held)
        yield pd.DataFrame(failed, columns=["url_key", "error"])

    failed = tables.written(missing.select("url_key", "url").mapInPandas(run, "url_key string, error string"), "failed")
    known = stored(spark, folder).select(F.col("url_key").alias("__key"), "content")
    failed = failed.select(F.col("url_key").alias("__failed"), "error")
    d = rows.withColumn("__url_key", key)
    d = d.join(known, d["__url_key"] == known["__key"], "left").join(failed, d["__url_key"] == failed["__failed"], "left")
    error = F.when(F.col(url).isNull(), F.lit("ValueError: no URL")).otherwise(F.col("error"))
    return d.select(*rows.columns, "content", error.alias("error"))
