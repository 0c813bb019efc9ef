"""What keeps queries within their limits on larger tables: plans that broadcast nothing exploded, and work that follows the rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels, pixels
from gridloom.operators import tiles, training
from gridloom.plans import oracles, queries
from tests.compare import DATA, check

Q, SQL = queries.queries(), oracles.oracle_sql()


def planned(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_nearest_does_not_broadcast_pixels(spark):
    """the optimizer takes pixels for as small as the parts that they were exploded from."""
    plan = planned(Q["r23b_pixel_nearest"](spark, DATA))
    assert "Broadcast" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("old,new", [((9, 12), (5, 20)), ((3, 2), (7, 5)), ((4, 6), (1, 1)), ((5, 5), (5, 5))])
def test_nearest_of_many_sizes(spark, old, new):
    (h, w), (nh, nw) = old, new
    rows = [(1, y, x, c, 100 * y + 10 * x + c) for y in range(h) for x in range(w) for c in range(2)] + [(2, y, x, 0, y - x) for y in range(2) for x in range(3)]
    d = spark.createDataFrame([*rows, (None, 0, 0, 0, 1), (1, 0, 0, None, 1)], "image long, y int, x int, c int, v int")
    got = sorted(tuple(r) for r in pixels.nearest(d, F.col("y") + 1, F.col("x") + 1, nh, nw).select("image", "y", "x", "c", "v").collect())
    at = {r[:4]: r[4] for r in rows}
    sides = {(1, 0): old, (1, 1): old, (2, 0): (2, 3)}
    assert got == sorted((i, y, x, c, at[i, y * hh // nh, x * ww // nw, c]) for (i, c), (hh, ww) in sides.items() for y in range(nh) for x in range(nw))


def test_contrast_neither_sorts_nor_broadcasts_pixels(spark):
    """pixels stay where their parts were dealt to; all of them were sorted twice."""
    plan = planned(Q["r23_pixel_ops"](spark, DATA))
    assert not any(n in plan for n in ("Broadcast", "Window", "Sort ")) and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_contrast_by_rounded_mean(spark):
    spots = {(1, 0, 0): (100, 50, 200), (1, 0, 1): (7, 9, 250), (2, 0, 0): (1, 2, 3)}
    d = spark.createDataFrame([(*s, c, v) for s, vs in spots.items() for c, v in enumerate(vs)] + [(3, 0, 0, 0, None), (None, 0, 0, 0, 5)], "image long, y int, x int, c int, v int")
    grey = lambda v: (299 * v[0] + 587 * v[1] + 114 * v[2] + 500) // 1000
    means = {i: int(sum(g) / len(g) + 0.5) for i in (1, 2) for g in [[grey(v) for s, v in spots.items() if s[0] == i]]}
    got = {(r.image, r.y, r.x, r.c): r.v for r in pixels.contrast(d, 0.5).collect()}
    assert {k for k in got if k[0] == 3} == {(3, 0, 0, 0)}  # a row without values stays
    assert {k: v for k, v in got.items() if k[0] != 3} == {(*s, c): int((means[s[0]] + 0.5 * (v - means[s[0]])) // 1) for s, vs in spots.items() for c, v in enumerate(vs)}


def test_labels_do_not_broadcast_tiles(spark):
    """tiles are exploded from the parts, so the optimizer took their labels for few."""
    assert "Broadcast" not in planned(Q["r08_tile_overlap_label"](spark, DATA))


def test_labels_of_odd_tiles(spark):
    t = spark.createDataFrame([(1, 0, 0, 0, 4, 4, "a"), (1, 0, 0, 0, 4, 4, "a"), (1, 1, 4, 0, 8, 4, "b"), (2, 0, 0, 0, 4, 4, "c"), (None, 0, 0, 0, 4, 4, "d"), (3, 0, None, 0, 4, 4, "e")], "image_id long, index int, x_min int, y_min int, x_max int, y_max int, more string")
    b = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (1, 0.0, 0.0, 4.0, 4.0), (2, 4.0, 0.0, 8.0, 4.0), (None, 0.0, 0.0, 9.0, 9.0), (3, 0.0, 0.0, 9.0, 9.0)], "image_id long, x_min double, y_min double, x_max double, y_max double")
    got = tiles.labelled(t, b)
    assert got.columns == [*t.columns, "label"] and sorted((r.more, r.label) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 0), ("c", 0), ("d", 0), ("e", 0)]


def test_only_wanted_rows_and_columns_are_resized():
    """`rough` made 130 x 130 pixels of every picture, and then picked few of them."""
    a = np.random.default_rng(3).integers(0, 256, (31, 47, 3), dtype=np.uint8)
    rows, cols = np.array([0, 5, 129, 64]), np.array([128, 3, 3])
    assert (kernels.bilinear(a, 130, 130, rows, cols) == kernels.bilinear(a, 130, 130)[rows][:, cols]).all()
    assert (kernels.rough(a) == kernels.nearest(kernels.bilinear(a, 130, 130), 31, 47)).all()


def test_tiles_keep_other_columns(spark):
    """each image made a pandas frame of its own, in which integers beside a null became floats."""
    d = spark.createDataFrame([(None if i == 3 else i, [i, None], 9, 9, 1, bytearray([i] * 81)) for i in range(40)] + [(99, None, 2, 2, 1, bytearray(4))], "image_id long, more array<int>, height int, width int, nChannels int, data binary")
    got = kernels.tiled(d).collect()
    assert sorted((r.more[0], r["index"]) for r in got) == [(i, k) for i in range(40) for k in range(9)] and {r.image_id for r in got if r.more[0] == 3} == {None}
    assert all(r.more == [r.more[0], None] and bytes(r.data) == bytes([r.more[0]] * 9) and (r.height, r.width, r.nChannels) == (3, 3, 1) for r in got)


def test_steps_are_not_jobs(spark, monkeypatch):
    """each step was a job; an epoch is one stage whose tasks add up batches, with the results of steps that are jobs."""
    r = np.random.default_rng(8)
    d = spark.createDataFrame([(k, r.normal(size=5).tolist(), k % 3) for k in range(151)], "id long, x array<double>, label int").repartition(3)
    head, jobs = training.Head.new(5, 3, seed=2), []
    summed = training.summed
    monkeypatch.setattr(training, "summed", lambda *a, **k: (jobs.append(1), summed(*a, **k))[1])

    def trained(size):
        jobs.clear()
        best, series = training.fine_tuned(d.filter("id < 120"), d.filter("id >= 120"), "x", "label", "id", head, epochs=2, batch_size=size, rate=0.05)
        return len(jobs), np.concatenate([best.flat, np.array([tuple(r) for r in series.orderBy("epoch").collect()]).ravel()])

    for size in (7, 50, 1000):  # one task, several, and tasks without rows of some batches
        n, one = trained(size)
        assert n == 2  # the evaluations
        with monkeypatch.context() as m:
            m.setattr(training, "TOGETHER", 1)
            n, other = trained(size)
        assert n == 2 + 2 * -(-120 // size) and np.allclose(one, other, rtol=0, atol=1e-9)


def test_batches_of_a_prototype_add_no_jobs(spark):
    """as many jobs for 60 batches as for 2; it was one more for each batch."""
    d = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0], k % 3) for k in range(120)], "id long, x array<double>, label int").repartition(3)
    head, jobs = training.Head.new(3, 3, seed=5), {}
    for size in (4, 120):
        spark.sparkContext.setJobGroup(f"F6-{size}", "prototype")
        try:
            _, series = training.prototype(d, "x", "label", "id", head, epochs=2, batch_size=size)
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert series.count() == 2 * 120 // size
        jobs[size] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"F6-{size}"))
    assert 0 < jobs[4] <= jobs[120] + 2  # small stages of adaptive plans come and go


def plainly_recovered(a, clip=3.0, tiles=8):
    """clahe by a cube root and a power for each value."""
    to_xyz, white = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]), np.array([0.950456, 1.0, 1.088754])
    c = a[:, :, ::-1] / 255.0
    t = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) @ to_xyz.T / white
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = kernels.equalised(kernels.rounded((116 * f[..., 1] - 16) * 2.55), clip, tiles) / 2.55
    f = (light + 16)[..., None] / 116 + f - f[..., 1:2]
    linear = np.clip(np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * white @ np.linalg.inv(to_xyz).T, 0, 1)
    return kernels.rounded(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)[:, :, ::-1] * 255)


def seconds(f, *args):
    took = []
    for _ in range(30):
        began = time.perf_counter()
        f(*args)
        took.append(time.perf_counter() - began)
    return min(took)


def test_lightness_without_powers():
    """every value of every picture was raised to a power and had a cube root taken, over half of r24's time."""
    r = np.random.default_rng(5)
    for shape in ((49, 80, 3), (1, 1, 3), (9, 200, 3), (130, 70, 3)):
        for top in (3, 60, 256):  # dark ones too, which are on the straight part of both curves
            a = r.integers(0, top, shape, dtype=np.uint8)
            assert (kernels.clahe(a) == plainly_recovered(a)).all()
    a = r.integers(0, 256, (160, 200, 3), dtype=np.uint8)
    assert seconds(kernels.clahe, a) < 0.7 * seconds(plainly_recovered, a)


def test_every_byte_from_linear_light():
    """bytes are looked up by cells of linear light; about every place where one byte ends and the next begins, and at both ends, the bytes are those of the curve."""
    values = np.random.default_rng(6).random(300_000)
    edges = np.array([0.0, 1.0, 0.0031308, *(((byte + 0.5) / 255 + 0.055) / 1.055 for byte in range(255))])
    edges[3:] = np.where(edges[3:] * 1.055 - 0.055 <= 0.04045, (edges[3:] * 1.055 - 0.055) / 12.92, edges[3:] ** 2.4)
    for x in (values, edges, np.clip(edges + 1e-12, 0, 1), np.clip(edges - 1e-12, 0, 1)):
        assert (kernels.gamma(x) == kernels.rounded(np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055) * 255)).all()


@pytest.mark.parametrize("shape", [(300, 150, 3), (64, 88, 1), (10, 129, 3)])
def test_fog_in_stretches(shape):
    """lines are blurred by stretches, of which inner ones share their weights and outer ones have the mirrored edges folded in."""
    a = np.random.default_rng(8).integers(0, 256, shape, dtype=np.uint8)
    x = np.exp(-((np.arange(25) - 12) ** 2) / (2 * 4.1**2))  # 0.3 * ((25 - 1) * 0.5 - 1) + 0.8
    f = a.astype(float)
    for axis in (0, 1):
        wide = np.pad(f, [(12, 12) if k == axis else (0, 0) for k in range(3)], mode="reflect" if f.shape[axis] > 12 else "edge")
        f = np.apply_along_axis(np.convolve, axis, wide, x / x.sum(), "valid")
    assert (kernels.fog(a, 25) == kernels.rounded(f)).all()
