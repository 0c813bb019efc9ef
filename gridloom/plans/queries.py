"""Registered queries of the image-dataset operators over the driver's tables.

There are no images in these tables; orders stand for images, lineitem for annotations, part types
for categories, events for road-scene labels and embeddings for class scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import kernels, names, pixels
from gridloom.operators import curation, evaluation, model, sampling, scoring, tiles, training
from gridloom.sources import files

STRATA = {"similar": ["SMALL", "MEDIUM"], "different": ["LARGE", "ECONOMY"]}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    categories = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("pos", F.col("id"))
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), "o_totalprice")
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    coded = part.join(categories, part["p_type"] == categories["name"]).select("p_partkey", F.col("id").alias("category_id"))
    annotations = line.join(coded, line["l_partkey"] == coded["p_partkey"]).select(F.col("l_orderkey").alias("image_id"), "category_id", F.col("l_extendedprice").alias("area"))
    return images, annotations, categories


def r01_positive_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, annotations, categories = _dataset(spark, sf_dir)
    ids = curation.positive_ids(images, annotations, categories, "PROMO", F.try_divide("area", "o_totalprice"))
    return curation.chosen(images, ids, most=100).select("id", names.padded_id(F.col("id")).alias("name"))


def r02_negative_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, annotations, categories = _dataset(spark, sf_dir)
    return curation.negative_strata(annotations, categories, "PROMO", STRATA, most=50)


def r02b_overlap_of_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to treat an image of two strata, counted."""
    _, annotations, categories = _dataset(spark, sf_dir)
    both = curation.negative_strata(annotations, categories, "PROMO", STRATA)
    once = curation.negative_strata(annotations, categories, "PROMO", STRATA, exclusive=True)
    count = lambda d, mode: d.groupBy("stratum").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "stratum", "n")
    return count(both, "all").unionAll(count(once, "exclusive"))


def r02c_strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, annotations, categories = _dataset(spark, sf_dir)
    sampled = curation.negative_strata(annotations, categories, "PROMO", STRATA, most=50).select("image_id").distinct()
    return curation.strictly_joined(sampled, images).select("image_id", "o_totalprice")


def r03_parse_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.when(key % 3 == 0, names.variant_name(key, F.lit("original"))).when(key % 3 == 1, names.variant_name(key, F.lit("night"))).otherwise(names.variant_name(key, F.lit("original"), "other_"))
    listing = _t(spark, sf_dir, "part").select(made.alias("name"))
    return files.existing_ids(listing)


def r04_nested_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as scenes: the labels are their events; weather and time of day follow from the id."""
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("category"))).alias("labels"))
    weather = F.when(F.col("user_id") % 3 == 0, "rainy").when(F.col("user_id") % 3 == 1, "clear")
    time = F.when(F.col("user_id") % 4 == 0, "night").when(F.col("user_id") % 4 == 1, "daytime")
    scenes = e.select(F.concat(F.col("user_id").cast("string"), F.lit(".jpg")).alias("name"), "labels", F.struct(weather.alias("weather"), time.alias("timeofday")).alias("attributes"))
    return curation.bad_weather_scenes(scenes, "error").select("name", "copy_name")


def r05_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("cls"))
    return sampling.split(rows, "cls", "vec_id")


def r05b_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of one base image stay on one side."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("cls"), F.expr("p_partkey div 3").alias("base"))
    return sampling.split(rows, "cls", "p_partkey", base="base")


def r06_variant_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.fan_out(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), prefix="other_")


def r06b_variant_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random factors of each image's variants, the same in any partitioning."""
    d = curation.fan_out(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).filter("variant != 'original'")
    factor = F.when(F.col("variant") == "night", sampling.uniform("night", 0.2, 0.4, F.col("id"))).otherwise(sampling.uniform("rain", 0.5, 0.8, F.col("id")))
    return d.select("id", "variant", F.round(factor, 9).alias("factor"))


def _part_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") + 9).alias("width"), (F.col("p_size") * 2 + 7).alias("height"))
    return tiles.grid(part)


def r07_grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_tiles(spark, sf_dir)


def r08_tile_overlap_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") % 20, F.col("l_quantity") % 30
    boxes = line.select(F.col("l_partkey").alias("image_id"), x.alias("x_min"), y.alias("y_min"), (x + F.col("l_linenumber") * 3).alias("x_max"), (y + F.col("l_linenumber") * 5).alias("y_max"))
    return tiles.labelled(_part_tiles(spark, sf_dir), boxes).select("image_id", "index", "label")


def r08b_tile_label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part_tiles(spark, sf_dir).withColumn("boxes", F.array(F.struct(F.lit(5.0).alias("x_min"), F.lit(5.0).alias("y_min"), F.lit(12.0).alias("x_max"), F.lit(12.0).alias("y_max"))))
    return tiles.labelled_arrays(d).select("image_id", "index", "label")


def r09_coarse_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"tool": ["gear", "bolt", "widget"], "hot": ["hot", "red"], "ring": ["ring"]}
    part = _t(spark, sf_dir, "part")
    plain, whole = (F.array_join(scoring.coarse(F.col("p_name"), words, w), ",") for w in (False, True))
    return part.select("p_partkey", plain.alias("categories"), whole.alias("whole_words"))


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    return e.select("vec_id", F.posexplode(scoring.softmax(F.col("logits"))).alias("class_idx", "p"))


def r10_softmax_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probabilities(spark, sf_dir).withColumn("score", F.col("p"))
    return scoring.selected(p, 0.3).select("vec_id", "class_idx", F.round("p", 6).alias("p"))


def r11_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    place = scoring.best(F.col("embedding"))
    return e.select("vec_id", place.alias("best"), F.round(F.array_max("embedding").cast("double"), 6).alias("score"), (place == F.col("label")).alias("hit"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") >= 500).cast("int").alias("pred"))
    return _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


def r12_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.confusion(_predictions(spark, sf_dir), "lang")
    return d.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall")})


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to 40 epochs."""
    e = _t(spark, sf_dir, "events")
    accuracy = F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0))
    return e.groupBy((F.col("event_id") % 40).alias("epoch")).agg(F.round(accuracy, 3).alias("val_acc"))


def r13_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_epoch(_epochs(spark, sf_dir))


def r13b_published_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published series' best epoch beside the events' one."""
    series = spark.createDataFrame(evaluation.PUBLISHED, "epoch int, train_loss double, val_loss double, train_acc double, val_acc double")
    published = evaluation.best_epoch(series).select(F.lit("published").alias("series"), F.col("epoch").cast("bigint").alias("epoch"), "val_acc")
    return published.unionAll(evaluation.best_epoch(_epochs(spark, sf_dir)).select(F.lit("events"), F.col("epoch").cast("bigint"), "val_acc"))


def r14_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _t(spark, sf_dir, "part").select("p_brand").distinct()
    placed = sampling.numbered(brands, "place", names.natural_key(F.col("p_brand")), F.col("p_brand"))
    return placed.select("p_brand", (F.col("place") + 1).cast("int").alias("place"))


def r14b_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as files, dealt to clerks' folders, in natural order."""
    name = F.concat(F.lit("clerk "), (F.col("o_custkey") % 97).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    files_ = _t(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), "o_orderpriority")
    return sampling.numbered(files_, "place", names.natural_key(F.col("name")), F.col("name"))


def r15_grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).cast("bigint").alias("grid"), ((F.col("l_linenumber") - 1) % 9).alias("tile"), "l_returnflag")
    return tiles.as_grid(line, "grid", "tile", "l_returnflag")


def r16_detections_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("conf"), F.col("event_id").alias("pos"))
    return scoring.detections(e, "image").select("image", F.array_join("labels", ",").alias("labels"))


def r17_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "nation").filter("n_nationkey % 3 != 1 and n_nationkey < 9").select(F.col("n_nationkey").cast("int").alias("tile"), F.col("n_name").alias("mark"))
    return tiles.slots(found)


def r18_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three limits side by side: before what exists is left out, after it, and without it."""
    images, annotations, categories = _dataset(spark, sf_dir)
    ids = curation.positive_ids(images, annotations, categories, "PROMO", F.try_divide("area", "o_totalprice"))
    existing = images.filter("id % 2 = 0").select(F.col("id").alias("image_id"))
    before = curation.chosen(images, ids, 100, existing).select(F.lit("limit_first").alias("mode"), "id")
    after = curation.chosen(images, ids, 100, existing, new_only=True).select(F.lit("new_only").alias("mode"), "id")
    return before.unionAll(after)


def r18b_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    wanted = part.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("copy_"), F.col("p_partkey").cast("string")).alias("copy_name"))
    sources = part.filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("name"))
    made = part.filter("p_partkey % 5 = 0").select(F.concat(F.lit("copy_"), F.col("p_partkey").cast("string")).alias("name"))
    return curation.to_copy(wanted, sources, made).select("pos", "copy_name")


def r19_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.upper("lang"), F.lit("　")).alias("raw"))
    return docs.select("doc_id", scoring.normal_target(F.col("raw"), {"en": "english", "de": "german"}).alias("target"))


def _vocabulary(spark: SparkSession) -> DataFrame:
    """A label for each of the 64 classes: ten, and then things with numbers."""
    labels = ["school bus", "minibus", "trolleybus", "sports car", "traffic light", "mountain bike", "cabinet", "hydrant", "dog", "tandem"]
    things = ["jeep", "house", "tandem bicycle", "tree", "taxi", "lamp", "fire hydrant", "omnibus"]
    labels += [f"{things[k % 8]} {k}" for k in range(len(labels), 64)]
    return spark.createDataFrame(list(enumerate(labels)), "class_idx int, label string")


def r20_target_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.target_scores(_probabilities(spark, sf_dir), _vocabulary(spark), "vec_id", F.lit(" バス "))
    return scores.select("vec_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.05).alias("selected"))


def r20b_best_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scoring.best_classes(_probabilities(spark, sf_dir), "vec_id", 3)
    return scoring.categories_of_best(top, _vocabulary(spark), "vec_id").select("vec_id", F.array_join("categories", ",").alias("categories"))


def r21_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.expr("event_id div 32").alias("batch")).agg(F.avg("value").alias("loss"), F.count("*").alias("n"))
    return evaluation.losses(e).select(F.round("weighted_loss", 6).alias("weighted_loss"), F.round("mean_of_batches", 6).alias("mean_of_batches"))


def r22_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.improvements(_epochs(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic 12 x 9 pictures of three channels."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), "p_size")
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")  # parts are shuffled, so that their 324 times as many pixels need not be
    part = part.select("image", F.explode(F.sequence(F.lit(0), F.lit(12 * 9 * 3 - 1))).alias("k"), "p_size")
    v = (F.col("k") * 7 + F.col("p_size") * F.col("k") % 31 + F.col("image") * 13) % 256
    return part.select("image", F.expr("cast(k div 36 as int)").alias("y"), F.expr("cast(k div 3 % 12 as int)").alias("x"), F.expr("cast(k % 3 as int)").alias("c"), v.cast("int").alias("v"))


def r23_pixel_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("v", pixels.brightness(F.col("v"), 0.75))
    p = pixels.contrast(p, 0.5)
    return p.select("image", "y", "x", "c", "v", F.round(pixels.normalised(F.col("v"), F.col("c")), 6).alias("n"), pixels.flipped(F.col("x"), F.lit(12)).alias("flipped_x"), pixels.tile_of(F.col("y"), F.col("x"), F.lit(9), F.lit(12)).alias("tile"))


def r23b_pixel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.nearest(_pixels(spark, sf_dir), F.col("y") + 1, F.col("x") + 1, 5, 20)


@lru_cache(64)
def _pattern(h: int, w: int) -> np.ndarray:
    y, x, c = np.ogrid[0:h, 0:w, 0:3]
    return (y * 3 + x * 5 + c * 40).astype(np.uint8)


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic BGR rasters, one for each part."""

    def paint(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), 100):
                out = []
                for key, size in part.iloc[start : start + 100].itertuples(index=False):
                    h, w = 24 + int(size), 30 + int(size) * 2
                    out.append((key, h, w, 3, (_pattern(h, w) + np.uint8(key * 11 % 256)).tobytes()))  # the last byte of each sum
                yield pd.DataFrame(out, columns=["image_id", "height", "width", "nChannels", "data"])

    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    part = part.repartition(part.sparkSession.sparkContext.defaultParallelism, "p_partkey")  # ids are few bytes, what is painted of them is not
    return part.mapInPandas(paint, "image_id long, height int, width int, nChannels int, data binary")


def r24_image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kernels.with_variants(_rasters(spark, sf_dir), tuple(kernels.VARIANT_KERNELS))
    return d.select("image_id", "variant", "height", "width", F.sha2("data", 256).alias("data_sha256"), "error")


def r24b_image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kernels.tiled(_rasters(spark, sf_dir))
    return d.select("image_id", "index", "height", "width", F.sha2("data", 256).alias("data_sha256"))


def r25_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed linear model behind the batch-scoring hook: two classes, an image's score and mark."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        weights = np.cos(np.arange(64))
        return lambda x: np.stack([x @ weights, -(x @ weights)], axis=1)

    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    p = scoring.softmax(F.col("scores"))
    d = e.withColumn("scores", model.scorer(load, 64)("features"))
    return d.select("vec_id", scoring.best(p).alias("pred"), F.round(F.array_max(p) * 100, 6).alias("percent"))


def r26_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the training split, evaluate on the rest."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    d = sampling.split(e.withColumn("cls", F.col("label").cast("string")), "cls", "vec_id")
    fitted = model.trained(d.filter("split = 'train'"), "embedding", "label", strength=0.01)
    out = evaluation.confusion(model.predicted(fitted, d.filter("split = 'val'"), "embedding"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


def _ten_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return sampling.split(e.withColumn("cls", F.col("label").cast("string")), "cls", "vec_id")


def r26b_fine_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head for the ten labels, batch by batch; the series of epochs."""
    d = _ten_classes(spark, sf_dir)
    _, series = training.fine_tuned(d.filter("split = 'train'"), d.filter("split = 'val'"), "embedding", "label", "vec_id", _first_head(), epochs=3, batch_size=256, rate=0.05)
    return series.select("epoch", *(F.round(c, 6).alias(c) for c in ("train_loss", "train_acc", "val_loss", "val_acc")), "improved")


def r26c_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over all rows without validation; batches' mean and the mean by rows, which a short last batch tells apart."""
    _, series = training.prototype(_t(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id", _first_head(), epochs=2, batch_size=192, rate=0.05)
    return evaluation.losses(series, "epoch").select("epoch", F.round("weighted_loss", 6).alias("weighted_loss"), F.round("mean_of_batches", 6).alias("mean_of_batches"))


def _first_head() -> training.Head:
    """Weights from a rule, ten classes of 64 features."""
    k, c = np.meshgrid(np.arange(64), np.arange(10), indexing="ij")
    return training.Head(np.cos(k * 10 + c) / 8, np.sin(np.arange(10)) / 8)


def r26d_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a head of ten classes, not trained yet, says of all rows."""
    d = training.classified(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", _first_head())
    return d.select("vec_id", "pred", F.round(F.array_max(scoring.softmax(F.col("scores"))), 6).alias("p"))


def r27_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.batches(_t(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    return d.groupBy("batch").agg(F.count("*").alias("n"))


def r27b_epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of batches, each read whole: rows and first ids of what reached the function."""

    def said(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole:
            ids = b.column("vec_id").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("epoch").slice(0, 1), b.column("batch").slice(0, 1), pa.array([len(ids)]), pa.array([ids.min()]), pa.array([ids.sum()])], names=["epoch", "batch", "n", "least", "ids"])

    d = sampling.epoch_batches(_t(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 3)
    return sampling.batch_scan(d, said, "epoch int, batch long, n long, least long, ids long")


def r28_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _epochs(spark, sf_dir).select("epoch", F.lit("val").alias("phase"), (1 - F.col("val_acc")).alias("loss"), F.col("val_acc").alias("acc"))
    return evaluation.report(d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("r") and name[1:3].isdigit()}
