"""Extension: a folder of listings as a stream, each id handled once across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def listings(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files of the folder, as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def new_only(stream: DataFrame, key: str, made: DataFrame | None = None) -> DataFrame:
    """The first row of each key that `made` (a table) does not have yet."""
    fresh = stream.join(made.select(key), key, "left_anti") if made is not None else stream
    return fresh.dropDuplicates([key])


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now, then end; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
