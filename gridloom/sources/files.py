"""Image files, archives and fetched content as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from gridloom.functions import names
from gridloom.operators import sampling
from gridloom.sources import archives

SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp")


def required(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError that names all the paths (or patterns) at which there is nothing."""
    missing = []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


def file_list(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png"), case_sensitive: bool = False) -> DataFrame:
    """path, name, size of the files with these suffixes; contents are not read."""
    required(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", names.base_name(F.col("path")).alias("name"), F.col("length").alias("size"))
    name = F.col("name") if case_sensitive else F.lower("name")
    return files.filter(name.rlike(rf"\.({'|'.join(suffixes)})$"))


def natural_list(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder with `index`, their 0-based place in natural order."""
    files = file_list(spark, path, SUFFIXES).withColumn("key", names.natural_key(F.col("path")))
    return sampling.numbered(files, "index", F.col("key"), F.col("path")).drop("key")


def rasters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readable images (Spark's image struct, flattened) and the origins of unreadable ones."""
    required(spark, path)
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return images.filter("height > 0"), images.filter("height <= 0").select("origin")


def labelled_folders(spark: SparkSession, path: str) -> DataFrame:
    """Images under path/<cls=name>/ with cls and class_index, the alphabetical rank of the class."""
    required(spark, path)
    images = spark.read.format("image").load(path)
    classes = spark.read.format("binaryFile").load(path).select("cls").distinct()  # from the listing, without contents
    ranked = classes.withColumn("class_index", F.dense_rank().over(Window.orderBy("cls")) - 1)  # a row for each class
    return images.join(ranked, "cls").select("image.*", "cls", "class_index")


def zip_entries(spark: SparkSession, path: str, wanted: str = ".*", partition_bytes: int = 64 << 20) -> DataFrame:
    """archive, entry, size, content for each file in the zip archive (or in those of a folder) whose name matches; see `archives`."""
    required(spark, path)
    return archives.entries(spark, path, wanted, partition_bytes)


def fetched(rows: DataFrame, url: str, transport: Callable[[str], bytes]) -> DataFrame:
    """rows with content and error; one of both is null. transport fetches a URL and is given by the caller. `store.fetched_once` keeps what it fetches.

    Tasks may run again after a failure, so the transport must be safe to repeat.
    """
    def one(address: str) -> tuple[bytes | None, str | None]:
        try:
            return transport(address), None
        except Exception as e:  # the row carries the error, the job goes on
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(a) for a in part[url]]
            yield part.assign(content=[c for c, _ in got], error=[e for _, e in got])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("content", BinaryType()), StructField("error", StringType())]))


def existing_ids(listing: DataFrame, ending: str = "_original.jpg") -> DataFrame:
    """Image ids that names of already made files begin with; names that do not parse are left out. listing: name."""
    made = listing.filter(F.col("name").endswith(ending))
    return made.select(names.leading_id(F.col("name")).alias("image_id")).filter("image_id is not null").distinct()
