"""Row identity and written intermediate tables, shared by the operators that shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import text as tx

#: Two hashes of id and text, never null: they name a row in joins, whatever type its id has.
KEYS = ("row_key", "row_check")
#: Partitions of a hash partition by homes or ranges at most; a task has several of these then, one after another.
MOST_TASKS = 20_000


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hand Python at most `most` bytes of rows at a time, so that long texts do not fill its workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    size = int("".join(c for c in now if c.isdigit() or c == "-") or -1) * unit
    if size <= 0 or size > most:
        spark.conf.set(name, f"{most}b")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, row_check and text (null: empty). Rows of one id with different texts differ in their keys."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = (c.alias(k) for c, k in zip(key_columns(id_col, text_col), KEYS, strict=True))
    return docs.select(F.col(id_col).alias("doc_id"), *keys, text.alias("text"))


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """The two hashes that name a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(F.col(id_col), text), F.xxhash64(text, F.lit("check"), F.col(id_col))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with the hashes that name its rows, in two columns of new names."""
    names = [f"{k}_{uuid.uuid4().hex}" for k in KEYS]
    return docs.withColumns(dict(zip(names, key_columns(id_col, text_col), strict=True))), names


def with_info(docs: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    """docs (from keyed) joined to one row of `info` for each row name."""
    more = [c for c in info.columns if c not in KEYS]
    return docs.join(info, list(KEYS), how).select(*docs.columns, *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one of ours where that is unset and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder before the application ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder (at `path`, if given): computed once, and no lineage behind it."""
    path = path or new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """docs (from keyed) with column packed (zstd) and size (bytes) for text, to be shuffled in less space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            data, bounds = tx.flat(batch.column("text"))
            view = memoryview(data)
            values = [codec.compress(view[a:b], asbytes=True) if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            others = [c for c in batch.schema.names if c != "text"]
            columns = [*(batch.column(c) for c in others), pa.array(values, pa.binary()), pa.array(np.diff(bounds), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "packed", "size"])

    # The nullability is kept, so that inner and outer joins with these rows can share one exchange.
    more = [T.StructField("packed", T.BinaryType()), T.StructField("size", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.drop("text").schema.fields, *more]))


def wanted_texts(docs: DataFrame, wanted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of docs (from keyed) that `wanted`, a written table, names, with its other columns. Up to `most` names (few bytes each) are broadcast, more are joined."""
    if wanted.count() <= most:
        return docs.join(F.broadcast(wanted), list(KEYS))
    return packed(docs).join(wanted, list(KEYS))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = tx.CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, text bytes and text bounds, for at most `limit` bytes of text (or one longer text) at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if "packed" not in batch.schema.names:
            data, bounds = tx.flat(batch.column("text"))
            for i, j in tx.chunked(bounds, limit):
                yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            continue
        sizes = batch.column("size").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        texts = batch.column("packed")
        for i, j in tx.chunked(bounds, limit):
            raw = b"".join(codec.decompress(texts[k].as_buffer(), int(sizes[k]), asbytes=True) for k in range(i, j) if sizes[k])
            yield batch.slice(i, j - i), np.frombuffer(raw, dtype=np.uint8), bounds[i : j + 1] - bounds[i]


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to `right`, an aggregate of left by `on` (the last of which is a long), so that hot keys can be split.

    An aggregate already lies dealt out by its keys, and a join that reads it so is bound to that deal. Keys the
    optimizer takes for new ones give both sides exchanges of their own, whose large partitions AQE splits.
    """
    last = on[-1]
    right = right.select(*(F.col(c).alias(f"__{c}") for c in on[:-1]), F.col(last).bitwiseXOR(F.lit(1)).alias(f"__{last}"), *(c for c in right.columns if c not in on))
    same = left[last].bitwiseXOR(F.lit(1)) == right[f"__{last}"]
    for c in on[:-1]:
        same = same & (left[c] == right[f"__{c}"])
    return left.join(right, same, how).drop(*(f"__{c}" for c in on))
