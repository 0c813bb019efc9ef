"""Hooks for models, numbered and batched rows, subsets of documents, missing inputs."""

import time

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from gridloom.operators import evaluation, model, sampling, scoring
from gridloom.sources import annotations, files


def test_detector_over_rasters(spark):
    """A detector that finds each bright pixel."""

    def load():
        def find(arrays):
            return [[("bus" if v > 200 else "car", float(v) / 255, (x, y, x + 1, y + 1)) for y, x in zip(*np.nonzero(a[:, :, 0]), strict=True) for v in (a[y, x, 0],)] for a in arrays]

        return find

    dark, some = np.zeros((2, 3, 1), np.uint8), np.zeros((2, 3, 1), np.uint8)
    some[0, 1], some[1, 2], some[1, 0] = 255, 20, 150
    d = spark.createDataFrame([(n, 2, 3, 1, bytearray(a.tobytes())) for n, a in (("dark", dark), ("some", some), ("again", some))], "origin string, height int, width int, nChannels int, data binary")
    found = model.detected(d, load, batch_size=2)
    r = found.filter("origin = 'some'").orderBy("pos").collect()
    assert [(x.label, x.x_min, x.y_max) for x in r] == [("bus", 1.0, 1.0), ("car", 0.0, 2.0), ("car", 2.0, 2.0)]
    assert {x.origin: x.labels for x in scoring.detections(found, "origin").collect()} == {"some": ["bus", "car"], "again": ["bus", "car"]}


def test_best_model_is_saved(spark, tmp_path):
    r = np.random.default_rng(2)
    data = [(i, [float(x) for x in r.normal(size=5)]) for i in range(400)]
    d = spark.createDataFrame([(i, x, int(x[0] + 0.5 * x[1] > 0)) for i, x in data], "id long, x array<double>, label int")
    path = str(tmp_path / "best")
    series = model.trained_by_epochs(d.filter("id < 300"), d.filter("id >= 300"), "x", "label", path, epochs=4)
    rows = series.orderBy("epoch").collect()
    assert [x.epoch for x in rows] == [1, 2, 3, 4] and rows[-1].train_loss < rows[0].train_loss and rows[0].improved
    best = max(rows, key=lambda x: (x.val_acc, -x.epoch))
    assert best.improved and evaluation.best_epoch(series).first().epoch == best.epoch
    loaded = LogisticRegressionModel.load(path)
    again = model.predicted(loaded, d.filter("id >= 300"), "x")
    assert again.filter("pred = label").count() / 100 == pytest.approx(best.val_acc) and best.val_acc > 0.9


@pytest.mark.parametrize("n", [0, 1, 64, 100])
def test_batches_are_exact(spark, n):
    got = sampling.batches(spark.range(n).repartition(3), "id").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [32] * (n // 32) + ([n % 32] if n % 32 else [])


def test_numbered(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert all(r.place == r.v for r in sampling.numbered(d, "place", F.col("v")).collect())
    assert sampling.numbered(d.limit(0), "place", F.col("v")).count() == 0


def test_numbered_keeps_wide_rows(spark):
    """Ranges of rows with wide columns have other bounds in another plan; also where AQE joins them."""
    d = spark.range(600_000).select(F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.sha2((-F.col("id")).cast("string"), 512).alias("wider"))
    want = d.select("v").toPandas()["v"].sort_values(ignore_index=True)
    for advisory in ("64m", "200k"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        try:
            got = sampling.numbered(d, "place", F.col("v")).select("place", "v", "wide").toPandas().sort_values("place", ignore_index=True)
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        assert (got["place"] == range(600_000)).all() and (got["v"] == want).all() and got["wide"].nunique() == 600_000


def test_indexed(spark):
    d = spark.range(5000).repartition(7)
    assert sorted(r.n for r in sampling.indexed(d, "n").collect()) == list(range(5000))
    assert sampling.indexed(d.filter("id = 3"), "n").collect()[0].n == 0


def test_softmax_of_many_classes(spark):
    """1,000 classes take about 20 times as long as 50, not their cube."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 1000)) * 5
    d = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)] + [(60, None), (61, [])], "id int, x array<double>").repartition(4)
    got = {q.id: q.p for q in d.select("id", scoring.softmax(F.col("x")).alias("p")).collect()}
    e = np.exp(x - x.max(axis=1, keepdims=True))
    assert all(np.allclose(got[k], row, rtol=1e-12, atol=0) for k, row in enumerate(e / e.sum(axis=1, keepdims=True)))
    assert got[60] is None and got[61] == []
    rows = spark.range(4000).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.sin(k * (F.col("id") + 1))).alias("x"))
    began = time.monotonic()
    assert rows.select(F.sum(F.aggregate(scoring.softmax(F.col("x")), F.lit(0.0), lambda a, y: a + y))).first()[0] == pytest.approx(4000)
    assert time.monotonic() - began < 60  # 4 million classes; the square of 1,000 for each row would be 4 billion


def test_categories_without_names(spark):
    best = spark.createDataFrame([(1, 0), (1, 5), (2, 5), (3, 1)], "image int, class_idx int")
    vocabulary = spark.createDataFrame([(0, "school bus"), (1, "dog")], "class_idx int, label string")
    assert {r.image: r.categories for r in scoring.categories_of_best(best, vocabulary, "image").collect()} == {1: ["bus"], 2: [], 3: []}


def test_subset(spark):
    images = spark.createDataFrame([(i, 10 - i, ["train", "val"][i % 2]) for i in range(10)], "id long, pos long, split string")
    notes = spark.createDataFrame([(i, i % 3, 1.0) for i in range(10)] + [(3, 9, 2.0)], "image_id long, category_id long, area double")
    kinds = spark.createDataFrame([(0, "bus", 0), (1, "car", 1), (2, "dog", 2), (9, "cat", 3)], "id long, name string, pos long")
    t = annotations.subset({"images": images, "annotations": notes, "categories": kinds}, ["bus", "dog"], "val", most=2)
    assert sorted(r.id for r in t["images"].collect()) == [5, 9]  # the places in the document fall with the ids
    assert sorted((r.image_id, r.category_id) for r in t["annotations"].collect()) == [(5, 2), (9, 0)]
    assert {r.id for r in annotations.subset({"images": images, "annotations": notes, "categories": kinds}, ["bus"], most=None)["images"].collect()} == {0, 3, 6, 9}


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "there.json").write_text("[]")
    files.required(spark, str(tmp_path), str(tmp_path / "*.json"))
    with pytest.raises(FileNotFoundError, match="missing inputs: .*gone.*other"):
        files.required(spark, str(tmp_path / "gone"), str(tmp_path), str(tmp_path / "other*"))
    for read in (lambda p: annotations.road_scenes(spark, p), lambda p: annotations.coco_tables(spark, p), lambda p: files.rasters(spark, p), lambda p: files.natural_list(spark, p)):
        with pytest.raises(FileNotFoundError):
            read(str(tmp_path / "gone"))
