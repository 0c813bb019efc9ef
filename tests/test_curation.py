from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators import curation, evaluation, sampling, scoring, tiles
from gridloom.sources.files import existing_ids


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def dataset(spark):
    images = spark.createDataFrame([(i, i, 100, 100) for i in range(1, 6)] + [(6, 6, 0, 5)], "id long, pos long, width int, height int")
    annotations = spark.createDataFrame(
        [(1, 6, 1000.0), (2, 6, 600.0), (2, 6, 600.0), (3, 6, 10.0), (3, 8, 5000.0), (4, 8, 900.0), (4, 1, 900.0), (5, 18, 900.0), (6, 6, 3.0), (99, 6, 5000.0), (98, 8, 900.0)],
        "image_id long, category_id long, area double",
    )
    categories = spark.createDataFrame([(3, "car", 0), (6, "bus", 1), (8, "truck", 2), (1, "person", 3), (18, "dog", 4), (66, "bus", 5)], "id long, name string, pos long")
    return images, annotations, categories


def test_positives(spark):
    images, annotations, categories = dataset(spark)
    ids = curation.positive_ids(images, annotations, categories, "bus", curation.ratio(F.col("area"), F.col("width"), F.col("height")))
    assert rows(ids) == [(1,)]  # exactly a tenth counts, two small ones do not, no division by zero
    assert rows(curation.chosen(images, ids).select("id")) == [(1,)]


def test_limits_and_existing(spark):
    images, _, _ = dataset(spark)
    ids = images.select(F.col("id").alias("image_id"))
    made = ids.filter("image_id <= 2")
    assert rows(curation.chosen(images, ids, 3, made).select("id")) == [(3,)]
    assert rows(curation.chosen(images, ids, 3, made, new_only=True).select("id")) == [(3,), (4,), (5,)]


def test_negatives(spark):
    images, annotations, categories = dataset(spark)
    strata = {"similar": ["truck", "car"], "different": ["person", "dog", "unknown"]}
    assert rows(curation.negative_strata(annotations, categories, "bus", strata)) == [("different", 4), ("different", 5), ("similar", 4), ("similar", 98)]
    assert rows(curation.negative_strata(annotations, categories, "bus", strata, exclusive=True)) == [("different", 5), ("similar", 4), ("similar", 98)]
    try:
        curation.strictly_joined(curation.negative_strata(annotations, categories, "bus", strata), images).collect()
        raise AssertionError("an id without image passed")
    except Exception as e:
        assert "no image 98" in str(e)


def test_scenes(spark):
    data = [
        ("a.jpg", ("rainy", "daytime"), [("car",), ("bus",)]), ("b.jpg", ("clear", "night"), [("bus",)]), ("c.jpg", ("clear", "daytime"), [("bus",)]), ("d.jpg", ("rainy", "night"), [("car",)]),
        ("e.jpg", None, [("bus",)]), ("f.jpg", (None, "night"), [("bus",)]), ("g.jpg", ("rainy", "night"), None),
    ]
    d = spark.createDataFrame(data, "name string, attributes struct<weather: string, timeofday: string>, labels array<struct<category: string>>")
    assert rows(curation.bad_weather_scenes(d).select("copy_name")) == [("bdd__night_f.jpg",), ("bdd_clear_night_b.jpg",), ("bdd_rainy_daytime_a.jpg",)]


def test_first_successes(spark):
    d = spark.createDataFrame([(i,) for i in range(50)], "pos long")
    tried = []

    def attempt(part):
        tried.append(part.count())
        return part.withColumn("error", F.when(F.col("pos") % 2 == 0, "bad"))

    parts = curation.first_successes(d, attempt, 7, chunk=10)
    assert sorted(r.pos for p in parts for r in p.collect()) == [1, 3, 5, 7, 9, 11, 13] and len(tried) == 2


def test_existing_ids(spark):
    d = spark.createDataFrame([("000000000001_original.jpg",), ("000000000001_night.jpg",), ("other_000000000004_original.jpg",), ("000000000002.jpg",)], "name string")
    assert rows(existing_ids(d)) == [(1,)]


def test_names(spark):
    d = spark.createDataFrame([(1, "x"), (1234567890123456, "y")], "id long, v string")
    assert rows(d.select(names.variant_name(F.col("id"), F.lit("night")))) == [("000000000001_night.jpg",), ("1234567890123456_night.jpg",)]
    order = ["img/1.jpg", "img/2.jpg", "img/10.jpg", "img/B.jpg", "img/a1.jpg", "img/a1b.jpg", "img/a1²2.jpg"]
    d = spark.createDataFrame([(x,) for x in reversed(order)], "p string")
    assert [r.p for r in d.orderBy(names.natural_key(F.col("p"))).collect()] == order


def test_split_is_exact_and_the_same_in_any_partitioning(spark):
    d = spark.createDataFrame([(f"c{n}", f"{n}-{i}.jpg") for n in (4, 5, 9, 10, 53) for i in range(n)], "cls string, name string")
    one = rows(sampling.split(d.repartition(1), "cls", "name"))
    assert one == rows(sampling.split(d.repartition(8), "cls", "name"))
    got = {n: sum(1 for c, _, s in one if c == f"c{n}" and s == "val") for n in (4, 5, 9, 10, 53)}
    assert got == {4: 0, 5: 1, 9: 1, 10: 2, 53: 10}


def test_tiles(spark):
    d = tiles.grid(spark.createDataFrame([(1, 300, 300), (2, 10, 7)], "image_id long, width int, height int"))
    boxes = lambda *b: spark.createDataFrame([(1, *map(float, x)) for x in b], "image_id long, x_min double, y_min double, x_max double, y_max double")
    hit = lambda *b: [r["index"] for r in tiles.labelled(d, boxes(*b)).filter("label = 1").orderBy("index").collect()]
    assert hit((100, 100, 200, 200)) == [4] and hit((50, 50, 50, 50)) == [0] and hit((99, 99, 101, 101)) == [0, 1, 3, 4]
    assert rows(d.filter("image_id = 2").agg(F.max("x_max"), F.max("y_max"))) == [(9, 6)]


def test_slots_and_grid(spark):
    found = spark.createDataFrame([(t, "o") for t in range(9) if t != 5], "tile int, mark string")
    d = tiles.slots(found)
    assert rows(d.filter("status = 'missing'").select("tile")) == [(5,)]
    assert rows(tiles.as_grid(d.withColumn("g", F.lit(1)), "g", "tile", "mark").filter("row = 1").select("c0", "c1", "c2")) == [("o", "o", "missing")]


def test_scoring(spark):
    d = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 5.0])], "i int, l array<double>")
    assert rows(d.select("i", scoring.best(F.col("l")))) == [(0, 0), (1, 1)]
    assert all(abs(sum(r[0]) - 1) < 1e-12 for r in d.select(scoring.softmax(F.col("l"))).collect())
    v = spark.createDataFrame([(0, "school bus"), (1, "cabinet"), (2, "traffic light")], "class_idx int, label string")
    p = spark.createDataFrame([(0, 0, 0.05), (0, 1, 0.9), (0, 2, 0.05)], "image int, class_idx int, p double")
    score = lambda t: scoring.target_scores(p, v, "image", F.lit(t)).first().score
    assert score(" バス ") == 0.05 and score("BUS") == 0.05 and score("traffic light") == 0.05 and score("car") == 0.9 and abs(score("") - 1) < 1e-12
    assert scoring.selected(scoring.target_scores(p, v, "image", F.lit("bus"))).count() == 1
    try:
        scoring.best_classes(p, "image", 0)
        raise AssertionError
    except ValueError:
        pass


def test_detections(spark):
    d = spark.createDataFrame([("a", "car", 0.1, 0), ("a", "car", 0.3, 1), ("a", "dog", 0.09, 2)], "f string, label string, conf double, pos int")
    assert rows(scoring.detections(d, "f")) == [("a", ["car", "car"])]


def test_evaluation(spark):
    d = spark.createDataFrame([(0, 0), (0, 1)], "pred int, label int")
    r = evaluation.confusion(d).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.accuracy) == (0, 0, 1, 0.0, 0.0, 0.5)
    e = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, val_acc double")
    assert rows(evaluation.best_epoch(e)) == [(2, 0.9)]
    assert evaluation.best_epoch(e.withColumn("val_acc", F.lit(0.0))).count() == 0
    b = spark.createDataFrame([(1.0, 32), (4.0, 1)], "loss double, n int")
    r = evaluation.losses(b).first()
    assert abs(r.weighted_loss - 36 / 33) < 1e-12 and r.mean_of_batches == 2.5
