import numpy as np
import pytest

from gridloom.functions import kernels as k
from gridloom.sources import annotations, files, sinks
from gridloom.streaming import incremental

RNG = np.random.default_rng(3)


def picture(h=30, w=40, c=3):
    return RNG.integers(0, 256, (h, w, c), dtype=np.uint8)


def test_flat_pictures_stay_flat():
    flat = np.full((33, 47, 3), 120, dtype=np.uint8)
    for f in (lambda a: k.mosaic(a, 0.08), lambda a: k.fog(a, 25), k.rough, lambda a: k.stretched(a, 20)):
        assert (f(flat) == 120).all()
    assert len(np.unique(k.night(flat, k.draws(1)))) == 1


def test_lab_round_trip():
    a = picture()
    assert np.abs(k.lab_to_bgr(k.bgr_to_lab(a)).astype(int) - a).max() <= 1


def test_clahe_keeps_grey_grey():
    g = np.repeat(picture(c=1), 3, axis=2)
    out = k.clahe(g).astype(int)
    assert out.shape == g.shape and np.abs(out[..., 0] - out[..., 2]).max() <= 2


def test_seeded():
    a = picture()
    assert (k.rain(a, k.draws(7, "rain")) == k.rain(a, k.draws(7, "rain"))).all()
    assert (k.rain(a, k.draws(7)) == 200).any()


def test_small_mosaic_and_even_blur():
    assert k.mosaic(picture(5, 5), 0.08).shape == (5, 5, 3)
    with pytest.raises(ValueError):
        k.fog(picture(), 4)


def test_model_input():
    a = k.model_input(picture(10, 20), 16)
    assert a.shape == (3, 16, 16) and a.dtype == np.float32
    assert np.allclose(a[:, 0, 0], -np.array(k.MEAN) / np.array(k.DEVIATION), atol=1e-5)  # black bar on top
    assert k.model_input(picture(c=1), 8, "stretch").shape == (3, 8, 8)


def test_cut_drops_the_rest():
    parts = k.cut(picture(10, 7))
    assert len(parts) == 9 and parts[8].shape == (3, 2, 3)


def test_files(spark, tmp_path):
    for cls in ("bus", "other"):
        (tmp_path / f"cls={cls}").mkdir()
        for i in (10, 2):
            a = picture(6, 5)
            (tmp_path / f"cls={cls}" / f"{i}.png").write_bytes(sinks.png(6, 5, 3, a.tobytes()))
    (tmp_path / "cls=bus" / "bad.jpg").write_bytes(b"no picture")
    (tmp_path / "cls=bus" / "notes.txt").write_text("x")
    good, bad = files.rasters(spark, str(tmp_path / "cls=bus" / "*g"))
    assert good.count() == 2 and bad.count() == 1
    assert bytes(good.filter("origin like '%/10.png'").first().data)[:3] != b""
    listed = files.natural_list(spark, str(tmp_path / "cls=bus")).orderBy("index").collect()
    assert [r["name"] for r in listed] == ["2.png", "10.png", "bad.jpg"]
    labelled = files.labelled_folders(spark, str(tmp_path)).filter("height > 0")
    assert sorted((r.cls, r.class_index) for r in labelled.select("cls", "class_index").distinct().collect()) == [("bus", 0), ("other", 1)]


def test_png_round_trip(spark, tmp_path):
    a = picture(4, 3)
    d = spark.createDataFrame([("x", 4, 3, 3, bytearray(a.tobytes()))], "name string, height int, width int, nChannels int, data binary")
    assert sinks.export_files(d, f"file://{tmp_path}/out").count() == 1
    r = spark.read.format("image").load(f"{tmp_path}/out").select("image.*").first()
    assert bytes(r.data) == a.tobytes()


def test_fetch_and_zip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("annotations/one.json", "{}")
        z.writestr("readme.txt", "x")
    assert [r.entry for r in files.zip_entries(spark, str(tmp_path), r"\.json$").collect()] == ["annotations/one.json"]
    d = spark.createDataFrame([("good",), ("bad",)], "url string")

    def transport(u):
        if u == "bad":
            raise OSError("gone")
        return u.encode()

    got = {r.url: (r.content, r.error) for r in files.fetched(d, "url", transport).collect()}
    assert bytes(got["good"][0]) == b"good" and got["bad"] == (None, "OSError: gone")


def test_variants_are_whole_or_an_error(spark):
    from gridloom.functions.kernels import tiled, with_variants

    a = picture(12, 12)
    d = spark.createDataFrame([(1, 12, 12, 3, bytearray(a.tobytes())), (2, 12, 12, 3, bytearray(b"short"))], "image_id long, height int, width int, nChannels int, data binary")
    got = with_variants(d).collect()
    assert sorted(r.variant for r in got if r.image_id == 1) == ["night", "original", "rain"]
    assert [r.error is not None for r in got if r.image_id == 2] == [True]
    assert tiled(d.filter("image_id = 1")).count() == 9


def test_coco(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"images": [{"id": 5, "width": 2, "height": 3, "coco_url": "u"}], "annotations": [{"image_id": 5, "category_id": 6, "area": 1.5, "segmentation": [[1]]}], "categories": [{"id": 6, "name": "bus"}]}')
    t = annotations.coco_tables(spark, str(tmp_path / "a.json"))
    assert t["images"].first().id == 5 and t["annotations"].first().area == 1.5
    doc = sinks.coco_document(*(t[n].drop("pos") for n in ("images", "annotations", "categories"))).first().value
    assert '"name" : "bus"' in doc
    (tmp_path / "b.json").write_text('[{"name": "x", "labels": [{"category": "bus"}]}, {"name": "y"}]')
    assert annotations.road_scenes(spark, str(tmp_path / "b.json")).count() == 2
    assert annotations.capped(t["images"], t["annotations"]).count() == 1


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([(1,), (1,), (2,), (3,)], "image_id long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = spark.createDataFrame([(3,)], "image_id long")
    stream = incremental.new_only(incremental.listings(spark, str(tmp_path / "in"), d.schema), "image_id", made)
    incremental.into_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.image_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
