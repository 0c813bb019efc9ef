"""Training batch by batch against numpy's on the same batches, and batches that reach functions whole."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation, model, sampling, scoring, training
from gridloom.plans import queries
from tests.compare import DATA


def data(spark, n=230, width=6, classes=3):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, width))
    y = (x @ r.normal(size=(width, classes))).argmax(axis=1)
    return x, y, spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(n)], "id long, x array<double>, label int").repartition(3)


def dealt(ids, size, seed):
    order = sorted(ids, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return [order[k : k + size] for k in range(0, len(order), size)]


def numpy_series(x, y, train, val, head, epochs, size, rate, seed="epoch"):
    w, b = head.weights.copy(), head.bias.copy()
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
    steps, out, each = 0, [], []

    def loss(rows):
        s = head.features(x[rows]) @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p, -np.log(p[range(len(rows)), y[rows]]).sum(), int((s.argmax(axis=1) == y[rows]).sum())

    for epoch in range(1, epochs + 1):
        total = hits = 0
        for rows in dealt(train, size, f"{seed}-{epoch}"):
            p, l, h = loss(rows)
            total, hits = total + l, hits + h
            each.append((epoch, len(rows), l / len(rows)))
            p[range(len(rows)), y[rows]] -= 1
            steps += 1
            for v, m, g in zip((w, b), moments, (head.features(x[rows]).T @ p / len(rows), p.mean(axis=0)), strict=True):
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                v -= rate * (m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.999**steps)) + 1e-8)
        line = [total / len(train), hits / len(train)]
        if val:
            _, l, h = loss(val)
            line += [l / len(val), h / len(val)]
        out.append(line)
    return np.array(out), each, w, b


def test_fine_tuning_equals_numpy(spark, tmp_path):
    x, y, d = data(spark)
    head, path = training.Head.new(6, 3, seed=1), str(tmp_path / "best")
    best, series = training.fine_tuned(d.filter("id < 180"), d.filter("id >= 180"), "x", "label", "id", head, epochs=3, batch_size=50, rate=0.03, path=path)
    want, *_ = numpy_series(x, y, list(range(180)), list(range(180, 230)), head, 3, 50, 0.03)
    got = series.orderBy("epoch").collect()
    assert np.allclose([[r.train_loss, r.train_acc, r.val_loss, r.val_acc] for r in got], want, rtol=0, atol=1e-9)
    top = int(want[:, 3].argmax()) + 1
    assert [r.epoch for r in got if r.improved][-1] == top == evaluation.best_epoch(series).first().epoch
    *_, w, b = numpy_series(x, y, list(range(180)), [], head, top, 50, 0.03)
    assert np.allclose(best.weights, w, atol=1e-9) and np.allclose(best.bias, b, atol=1e-9)
    again = training.Head.load(spark, path)
    assert (again.weights == best.weights).all() and (again.bias == best.bias).all()
    done = training.classified(d.filter("id >= 180"), "x", best)
    assert done.filter("pred = label").count() / 50 == pytest.approx(want[top - 1, 3])
    assert done.select(F.max(F.abs(F.aggregate(scoring.softmax(F.col("scores")), F.lit(0.0), lambda a, p: a + p) - 1))).first()[0] < 1e-12


def test_prototype_weighs_batches_alike_and_takes_over_a_body(spark):
    x, y, d = data(spark)

    def body(v):
        return np.tanh(v[:, :4])

    head = training.Head.new(4, 5, body, seed=2)  # two classes no row has
    fitted, series = training.prototype(d, "x", "label", "id", head, epochs=2, batch_size=100, rate=0.01)
    _, each, w, b = numpy_series(x, y, list(range(230)), [], head, 2, 100, 0.01)
    got = series.orderBy("epoch", "batch").collect()
    assert [r.n for r in got] == [100, 100, 30] * 2 and np.allclose([r.loss for r in got], [e[2] for e in each], atol=1e-9)
    assert np.allclose(fitted.weights, w, atol=1e-9) and np.allclose(fitted.bias, b, atol=1e-9)
    for r in evaluation.losses(series, "epoch").collect():
        mine = [e for e in each if e[0] == r.epoch]
        assert r.mean_of_batches == pytest.approx(sum(e[2] for e in mine) / 3) and r.weighted_loss == pytest.approx(sum(e[1] * e[2] for e in mine) / 230)
        assert abs(r.mean_of_batches - r.weighted_loss) > 1e-6
    even = evaluation.losses(training.prototype(d.filter("id < 200"), "x", "label", "id", head, epochs=1, batch_size=100)[1]).first()
    assert even.mean_of_batches == pytest.approx(even.weighted_loss)


def test_sums_go_up_a_tree(spark, monkeypatch):
    _, _, d = data(spark)
    monkeypatch.setattr(training, "FAN", 2)
    head = training.Head.new(6, 3)
    rows = d.select("x", F.col("label").cast("long").alias("y"))
    assert np.allclose(training.summed(rows.repartition(9), head, True), training.summed(rows.coalesce(1), head, True), atol=1e-9)


def test_a_large_batch_lies_in_several_ranges(spark):
    _, _, d = data(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins ranges as small as these
    try:
        table = training._by_batch(d, "x", "label", "id", 200, "epoch", 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.filter("batch = 0").select(F.input_file_name().alias("f")).distinct().count() > 1
    assert sorted(r["count"] for r in table.groupBy("batch").count().collect()) == [30, 200]


def test_rows_without_features_or_labels(spark):
    _, _, d = data(spark, 20)
    more = spark.createDataFrame([(100, None, 1), (101, [0.0] * 6, None)], d.schema)
    head = training.Head.new(6, 3)
    _, series = training.prototype(d.unionByName(more), "x", "label", "id", head, epochs=1, batch_size=7)
    assert sorted(r.n for r in series.collect()) == [6, 7, 7]
    assert {r.id: r.pred is None for r in training.classified(more, "x", head).collect()} == {100: True, 101: False}
    none, series = training.fine_tuned(d.limit(0), d.limit(0), "x", "label", "id", head, epochs=1)
    assert none is head and [r.val_acc for r in series.collect()] == [0.0]


@pytest.mark.parametrize("arrow", ["10000", "5"])
def test_batches_arrive_whole(spark, arrow):
    def said(whole):
        for b in whole:
            assert len({*b.column("epoch").to_pylist()}) == len({*b.column("batch").to_pylist()}) == 1
            yield pa.RecordBatch.from_arrays([b.column("epoch").slice(0, 1), b.column("batch").slice(0, 1), pa.array([b.column("id").to_pylist()])], names=["epoch", "batch", "ids"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        d = sampling.epoch_batches(spark.range(100).repartition(3), "id", 2)
        got = {(r.epoch, r.batch): sorted(r.ids) for r in sampling.batch_scan(d, said, "epoch int, batch long, ids array<long>").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(e, k): sorted(b) for e in (1, 2) for k, b in enumerate(dealt(range(100), 32, f"epoch-{e}"))}
    assert got[1, 0] != got[2, 0]


def test_registered_training_equals_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.label for r in rows])
    place = {r.vec_id: k for k, r in enumerate(rows)}
    assert place == {k: k for k in range(len(rows))}
    d = queries._ten_classes(spark, DATA)
    train, val = ([r.vec_id for r in d.filter(f"split = '{s}'").collect()] for s in ("train", "val"))
    want, *_ = numpy_series(x, y, train, val, queries._first_head(), 3, 256, 0.05)
    got = queries.r26b_fine_tuning(spark, DATA).orderBy("epoch").collect()
    assert np.allclose([[r.train_loss, r.train_acc, r.val_loss, r.val_acc] for r in got], want, atol=1e-6)
    _, each, *_ = numpy_series(x, y, list(range(len(rows))), [], queries._first_head(), 2, 192, 0.05)
    for r in queries.r26c_prototype(spark, DATA).collect():
        mine = [e for e in each if e[0] == r.epoch]
        assert r.mean_of_batches == pytest.approx(np.mean([e[2] for e in mine]), abs=1e-6) and r.weighted_loss == pytest.approx(sum(e[1] * e[2] for e in mine) / len(rows), abs=1e-6)


def test_registered_stand_in_equals_its_metrics(spark):
    """r26 against the confusion of its own model's probabilities, counted in numpy."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    d = sampling.split(e.withColumn("cls", F.col("label").cast("string")), "cls", "vec_id")
    fitted = model.trained(d.filter("split = 'train'"), "embedding", "label", strength=0.01)
    val = d.filter("split = 'val'").collect()
    s = np.array([r.embedding for r in val], dtype=np.float64) @ fitted.coefficients.toArray() + fitted.intercept
    pred, y = s > 0, np.array([r.label for r in val]) == 1
    got = queries.r26_training(spark, DATA).first()
    assert (got.n, got.tp, got.fp, got.fn) == (len(val), (pred & y).sum(), (pred & ~y).sum(), (~pred & y).sum())
    assert got.accuracy == pytest.approx((pred == y).mean(), abs=1e-6) and got.precision == pytest.approx((pred & y).sum() / max(pred.sum(), 1), abs=1e-6)
