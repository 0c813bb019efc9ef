"""Choosing positive and negative examples from annotation tables.

Joins are declared and left to the optimizer: dimensions are broadcast if they are small enough.
images: id, pos and more; annotations: image_id, category_id and more; categories: id, name, pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import tables
from gridloom.functions import names
from gridloom.operators import sampling


def category_ids(categories: DataFrame, wanted: list[str]) -> DataFrame:
    """category_id and name of the wanted categories, the first of each name; unknown names are left out."""
    return categories.filter(F.col("name").isin(wanted)).groupBy("name").agg(F.min_by("id", "pos").alias("category_id"))


def ratio(area: Column, width: Column, height: Column) -> Column:
    """The part of the image an annotation covers; null for an image without area."""
    return F.try_divide(area, width.cast("bigint") * height.cast("bigint"))


def positive_ids(images: DataFrame, annotations: DataFrame, categories: DataFrame, wanted: str, share: Column, least: float = 0.1) -> DataFrame:
    """image_id of images with one annotation of the category that alone covers `least` or more.

    share: a column over the joined annotation and image.
    """
    a = annotations.join(category_ids(categories, [wanted]).select("category_id"), "category_id")
    return a.join(images, a["image_id"] == images["id"]).filter(share >= F.lit(least)).select("image_id").distinct()


def chosen(images: DataFrame, ids: DataFrame, most: int | None = None, existing: DataFrame | None = None, new_only: bool = False) -> DataFrame:
    """The images with these ids, in their order.

    most: as many of them. existing (image_id): leave these out; the limit is applied before, or,
    with new_only, to what is new.
    """
    d = images.join(ids.select(F.col("image_id").alias("id")), "id", "left_semi")
    gone = existing.select(F.col("image_id").alias("id")) if existing is not None else None
    if gone is not None and new_only:
        d = d.join(gone, "id", "left_anti")
    if most is not None:
        d = d.orderBy("pos").limit(most)
    if gone is not None and not new_only:
        d = d.join(gone, "id", "left_anti")
    return d


def negative_strata(annotations: DataFrame, categories: DataFrame, excluded: str, strata: dict[str, list[str]], most: int | None = None, seed: str = "negatives", exclusive: bool = False) -> DataFrame:
    """stratum, image_id: images without any annotation of `excluded`, that have a category of the stratum.

    An image can be in two strata; with `exclusive` the first in the order of `strata` has it.
    most: as many of each stratum, by hash.
    """
    bad = annotations.join(category_ids(categories, [excluded]).select("category_id"), "category_id").select("image_id")
    known = category_ids(categories, [c for cs in strata.values() for c in cs])
    place = F.coalesce(*(F.when(F.col("name").isin(cs), F.lit(i)) for i, cs in enumerate(strata.values())))
    label = F.element_at(F.array(*(F.lit(s) for s in strata)), F.col("stratum_no") + 1)
    found = annotations.join(known.withColumn("stratum_no", place).select("category_id", "stratum_no"), "category_id")
    found = found.join(bad, "image_id", "left_anti").select("stratum_no", "image_id")
    found = found.groupBy("image_id").agg(F.min("stratum_no").alias("stratum_no")) if exclusive else found.distinct()
    found = found.select(label.alias("stratum"), "image_id")
    if most is None:
        return found
    return sampling.first_per_group(found, "stratum", most, sampling.hash_order(seed, F.col("stratum"), F.col("image_id")), F.col("image_id"))


def strictly_joined(ids: DataFrame, images: DataFrame) -> DataFrame:
    """ids with their images; fails on an id without one."""
    d = ids.join(images, ids["image_id"] == images["id"], "left")
    return d.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no image "), F.col("image_id").cast("string"))).cast("bigint")).otherwise(F.col("id")))


def has_label(labels: Column, category: str) -> Column:
    """Whether an array of labels has the category; false for no array."""
    return F.coalesce(F.exists(labels, lambda x: x["category"] == category), F.lit(False))


def bad_weather_scenes(scenes: DataFrame, category: str = "bus") -> DataFrame:
    """Rainy or night scenes with the category, and the name of their copy."""
    weather, time = F.coalesce("attributes.weather", F.lit("")), F.coalesce("attributes.timeofday", F.lit(""))
    d = scenes.filter((weather == "rainy") | (time == "night")).filter(has_label(F.col("labels"), category))
    return d.withColumn("copy_name", names.scene_name(weather, time, F.col("name")))


def to_copy(wanted: DataFrame, sources: DataFrame, made: DataFrame, most: int = 100) -> DataFrame:
    """Of wanted (name, copy_name, pos) what has a source and no copy yet, the first `most` new ones."""
    d = wanted.join(sources.select("name"), "name", "left_semi").join(made.select(F.col("name").alias("copy_name")), "copy_name", "left_anti")
    return d.orderBy("pos").limit(most)


def fan_out(images: DataFrame, variants: tuple[str, ...] = names.VARIANTS, prefix: str = "") -> DataFrame:
    """A row for each image and variant, with the file's name."""
    d = images.withColumn("variant", F.explode(F.array(*(F.lit(v) for v in variants))))
    return d.withColumn("name", names.variant_name(F.col("id"), F.col("variant"), prefix))


def first_successes(rows: DataFrame, attempt, most: int, chunk: int = 200) -> list[DataFrame]:
    """attempt(rows) for chunks of rows in order of pos until `most` rows have no error; the results, limited, as written tables.

    attempt adds a column `error`; it is run once for each row of a chunk, and of no more chunks than are needed. The rows are sorted once.
    """
    placed = tables.written(sampling.numbered(rows, "__n", F.col("pos"), F.xxhash64(*rows.columns)), "attempts")
    last = placed.agg(F.max("__n")).first()[0]
    out, have, at = [], 0, 0
    while have < most and last is not None and at <= last:
        done = tables.written(attempt(placed.filter((F.col("__n") >= at) & (F.col("__n") < at + chunk))), "attempted")
        good = done.filter("error is null").orderBy("__n").limit(most - have).drop("__n")
        have, at = have + min(most - have, done.filter("error is null").count()), at + chunk
        out.append(good)
    return out
