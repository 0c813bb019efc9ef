"""Annotation documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import curation
from gridloom.sources import elements, files, paths, schemas


def coco_tables(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> dict[str, DataFrame]:
    """images, annotations and categories of a COCO document, each with `pos`, its place in the array; read by a task for about `split_bytes` each."""
    files.required(spark, path)
    kinds = {f.name: f.dataType.elementType for f in T.DataType.fromDDL(schemas.COCO).fields}
    if not paths.reachable(path):  # only Spark opens it: one task parses the whole object
        doc = spark.read.schema(schemas.COCO).option("multiLine", True).json(path)
        return {name: doc.select(F.posexplode(name).alias("pos", "row")).select("pos", "row.*") for name in kinds}
    found = elements.stretches(path, split_bytes)
    return {name: _parsed(elements.elements(spark, path, [s for s in found if s.key == name]), kind).select("pos", "row.*") for name, kind in kinds.items()}


def _parsed(found: DataFrame, kind: T.DataType) -> DataFrame:
    return found.select("pos", F.from_json("value", kind).alias("row"))


def road_scenes(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Items of a labelled road-scene document, with `pos`, their place in it; read by a task for about `split_bytes` each."""
    files.required(spark, path)
    if not paths.reachable(path):
        doc = spark.read.schema(schemas.ROAD_SCENES).option("multiLine", True).json(path)
        return doc.withColumn("pos", F.monotonically_increasing_id())
    found = [s for s in elements.stretches(path, split_bytes) if s.key is None]
    return _parsed(elements.elements(spark, path, found), T.DataType.fromDDL(schemas.ROAD_SCENES)).select("row.*", "pos")


def capped(images: DataFrame, wanted: DataFrame, most: int = 500) -> DataFrame:
    """Images with a wanted category, at most `most`, by place in the document. wanted: image_id."""
    ids = wanted.select(F.col("image_id").alias("id")).distinct()
    return images.join(ids, "id", "left_semi").orderBy("pos").limit(most)


def subset(tables: dict[str, DataFrame], classes: list[str], split: str | None = None, most: int | None = 500) -> dict[str, DataFrame]:
    """The tables of a document cut down to images with one of these classes, of this split (column split of images), at most `most`.

    Annotations are those of the kept images, of all classes; categories stay whole.
    """
    images = tables["images"] if split is None else tables["images"].filter(F.col("split") == split)
    wanted = tables["annotations"].join(curation.category_ids(tables["categories"], classes).select("category_id"), "category_id").select("image_id")
    kept = images.join(wanted.select(F.col("image_id").alias("id")), "id", "left_semi")
    kept = kept if most is None else kept.orderBy("pos").limit(most)
    annotations = tables["annotations"].join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return {"images": kept, "annotations": annotations, "categories": tables["categories"]}
