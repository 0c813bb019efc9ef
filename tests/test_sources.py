"""Archives and documents read in ranges, fetched content that is kept, first successes."""

import json
import random
import struct
import threading
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import curation
from gridloom.sources import annotations, archives, elements, files, sinks, store


def test_zip_entries_in_ranges(spark, tmp_path):
    r, want = random.Random(1), {}
    for archive in ("a.zip", "b.ZIP"):
        with zipfile.ZipFile(tmp_path / archive, "w") as z:
            for k in range(40):
                raw = r.randbytes(r.choice([0, 10, 5000]))
                kind = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2][k % 3]
                z.writestr(zipfile.ZipInfo(f"d/é{k}.json"), raw, kind)
                want[archive, f"d/é{k}.json"] = raw
            z.writestr("other.txt", b"x")
            z.mkdir("empty")
    got = archives.entries(spark, str(tmp_path), r"\.json$", partition_bytes=20_000)
    assert got.rdd.getNumPartitions() > 4
    assert {(r.archive.rsplit("/", 1)[1], r.entry): bytes(r.content) for r in got.collect()} == want
    assert files.zip_entries(spark, f"file://{tmp_path}/a.zip", "nothing").collect() == []
    assert files.zip_entries(spark, f"{tmp_path}/[ab].zip", "other").count() == 1
    with pytest.raises(FileNotFoundError):
        files.zip_entries(spark, str(tmp_path / "gone.zip"))


def test_zip_of_sparse_gigabytes(spark, tmp_path):
    """An archive of 3 GB, most of it a hole in the file: tasks seek over it."""
    path, big = tmp_path / "big.zip", (3 << 30) - 10
    with open(path, "wb") as f:
        places, names = [], [b"hole.bin", b"one.txt", b"two.txt"]
        for name, size, raw in zip(names, (big, 3, 4), (None, b"one", b"two!"), strict=True):
            places.append(f.tell())
            crc = zlib.crc32(raw) if raw else 0
            f.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 0, 0, 0, crc, size, size, len(name), 0) + name)
            f.write(raw) if raw else f.seek(size, 1)
        begin = f.tell()
        for name, at, size, raw in zip(names, places, (big, 3, 4), (None, b"one", b"two!"), strict=True):
            f.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 20, 20, 0, 0, 0, 0, zlib.crc32(raw) if raw else 0, size, size, len(name), 0, 0, 0, 0, 0, at) + name)
        f.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 3, 3, f.tell() - begin, begin, 0))
    assert path.stat().st_size > 3 << 30
    got = archives.entries(spark, str(path), r"\.txt$", partition_bytes=3)
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r.entry, bytes(r.content)) for r in got.collect()) == [("one.txt", b"one"), ("two.txt", b"two!")]


def documents():
    r = random.Random(2)
    texts = ["", 'quote " \\ back\\\\', "braces {[,]}", "é日本", "\\", 'x\\"', "]", "tab\t"]
    items = [{"name": r.choice(texts) + str(k), "attributes": {"weather": r.choice(["rainy", None]), "timeofday": "night"}, "labels": [{"category": r.choice(texts)} for _ in range(r.randint(0, 3))]} for k in range(300)]
    return [(json.dumps(items), len(items)), (json.dumps(items, indent=2, ensure_ascii=False), len(items)), (" [ ] ", 0), ("[[1, 2], {}, 3, \"a,b\"]", 4)]


@pytest.mark.parametrize("split,block", [(1, 3), (100, 64), (5000, 1 << 20), (1 << 20, 7)])
def test_stretches_cover_all_elements(tmp_path, split, block):
    for k, (text, many) in enumerate(documents()):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        raw, got = text.encode(), []
        for s in elements.stretches(str(path), split, block):
            assert s.key is None and s.pos == len(got)
            got += [json.loads(x) for x in elements.pieces(raw[s.start : s.end])]
        assert got == json.loads(text) and len(got) == many


def test_stretches_of_an_object(tmp_path):
    doc = {"info": {"list": [1, 2, [3]], "x": ["a]"]}, "images": [{"id": k, "tags": [k, [k]]} for k in range(50)], "none": [], 'k"ey': [1], "n": 5, "annotations": [{"s": "}],["}] * 7}
    path = tmp_path / "o.json"
    path.write_text(json.dumps(doc, indent=1))
    raw = path.read_bytes()
    for split, block in ((1, 5), (60, 1000), (1 << 20, 1 << 20)):
        got: dict = {}
        for s in elements.stretches(str(path), split, block):
            got.setdefault(s.key, []).extend(json.loads(x) for x in elements.pieces(raw[s.start : s.end]))
        assert got == {k: v for k, v in doc.items() if isinstance(v, list)}
    path.write_text('{"a": [1, 2')
    with pytest.raises(ValueError, match="ends within"):
        elements.stretches(str(path))


def test_large_documents_have_several_tasks(spark, tmp_path):
    doc = {"images": [{"id": k, "width": k, "height": 2, "coco_url": f"u,{k}]"} for k in range(500)], "annotations": [{"image_id": k, "category_id": 1, "area": k / 2, "segmentation": [[k, 1.5], {"x": "}"}]} for k in range(900)], "categories": [{"id": 1, "name": "bus"}]}
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps(doc))
    for split in (2000, 1 << 25):
        t = annotations.coco_tables(spark, path, split)
        assert (t["annotations"].rdd.getNumPartitions() > 5) == (split == 2000)
        assert [(r.pos, r.id, r.coco_url) for r in t["images"].orderBy("pos").collect()] == [(k, k, f"u,{k}]") for k in range(500)]
        assert [(r.pos, r.image_id, r.area) for r in t["annotations"].orderBy("pos").collect()] == [(k, k, k / 2) for k in range(900)]
        assert [(r.pos, r.id, r.name) for r in t["categories"].collect()] == [(0, 1, "bus")]
    (tmp_path / "s.json").write_text(documents()[1][0])
    d = annotations.road_scenes(spark, str(tmp_path / "s.json"), 3000)
    assert d.rdd.getNumPartitions() > 5
    old = spark.read.schema("name string, labels array<struct<category: string>>").option("multiLine", True).json(str(tmp_path / "s.json")).collect()
    assert [(r.name, r.labels) for r in d.orderBy("pos").collect()] == [(r.name, r.labels) for r in old] and d.columns == ["name", "attributes", "labels", "pos"]


def test_fetched_once(spark, tmp_path):
    """A second run calls nothing, a third only what failed."""
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = f"file://{tmp_path}/store"

    def transport(u):
        import uuid

        (calls / uuid.uuid4().hex).write_text(u)
        if u == "bad" and not (calls / "mended").exists():
            raise OSError("gone")
        return u.encode() * 1000

    def called():
        out = sorted(p.read_text() for p in calls.iterdir() if p.name != "mended")
        for p in calls.iterdir():
            if p.name != "mended":
                p.unlink()
        return out

    rows = spark.createDataFrame([(k, f"u{k % 7}") for k in range(20)] + [(20, "bad"), (21, "bad"), (22, None)], "id int, url string").repartition(3)
    want = {k: (f"u{k % 7}" * 1000, None) for k in range(20)} | {22: (None, "ValueError: no URL")}

    def got():
        return {r.id: (r.content and bytes(r.content).decode(), r.error) for r in store.fetched_once(rows, "url", transport, folder, tasks=3, part_bytes=3000).collect()}

    bad = {20: (None, "OSError: gone"), 21: (None, "OSError: gone")}
    assert got() == want | bad and called() == sorted(["bad", *(f"u{k}" for k in range(7))])
    assert got() == want | bad and called() == ["bad"]
    (calls / "mended").write_text("")
    assert got() == want | {20: ("bad" * 1000, None), 21: ("bad" * 1000, None)} and called() == ["bad"]
    assert got()[20] == ("bad" * 1000, None) and called() == []
    (tmp_path / "store" / ".half.part").write_bytes(b"left by a task that was killed")
    assert got()[5] == want[5] and called() == []


def test_first_successes_attempts_a_chunk_more_at_most(spark, tmp_path):
    def attempt(part):
        def run(parts):
            for p in parts:
                for k in p["pos"]:
                    (tmp_path / f"try-{k}-{threading.get_ident()}-{np.random.default_rng().integers(1 << 40)}").write_text("")
                yield p.assign(error=[None if k % 3 == 0 else "no" for k in p["pos"]])

        return part.mapInPandas(run, "id long, pos long, __n long, error string")

    rows = spark.range(1000).select("id", (999 - F.col("id")).alias("pos")).repartition(5)
    parts = curation.first_successes(rows, attempt, 20, chunk=25)
    assert [r.pos for p in parts for r in p.orderBy("pos").collect()] == list(range(0, 60, 3))
    assert len(list(tmp_path.iterdir())) == 75  # three chunks, each row once
    assert curation.first_successes(rows.limit(0), attempt, 20) == []
    assert sum(p.count() for p in curation.first_successes(rows.limit(10), attempt, 20)) <= 10


def test_coco_export_reads_back(spark, tmp_path):
    images = spark.range(300).select((300 - F.col("id")).alias("id"), F.lit(2).alias("width"), F.col("id").cast("int").alias("height"), F.concat(F.lit('u"\\'), F.col("id").cast("string")).alias("coco_url")).repartition(7)
    notes = spark.range(1000).select(F.col("id").alias("image_id"), (F.col("id") % 3).alias("category_id"), (F.col("id") / 3).alias("area"), F.when(F.col("id") % 2 == 0, F.lit("n\nl")).alias("note")).repartition(5)
    kinds = spark.createDataFrame([(0, "bus"), (1, "é")], "id long, name string")
    path = str(tmp_path / "out" / "c.json")
    sinks.write_coco(images, notes, kinds, path, block=1000)
    doc = json.loads((tmp_path / "out" / "c.json").read_text())
    assert [i["id"] for i in doc["images"]] == list(range(1, 301)) and doc["categories"] == [{"id": 0, "name": "bus"}, {"id": 1, "name": "é"}]
    assert [a["image_id"] for a in doc["annotations"]] == list(range(1000)) and doc["annotations"][2]["note"] == "n\nl" and "note" not in doc["annotations"][1]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["c.json"]
    t = annotations.coco_tables(spark, path, 4000)
    assert [tuple(r) for r in t["annotations"].orderBy("pos").collect()] == [(k, k, k % 3, k / 3) for k in range(1000)]
    sinks.write_coco(images.limit(0), notes.limit(0), kinds.limit(0), path)  # in place of what was there
    assert json.loads((tmp_path / "out" / "c.json").read_text()) == {"images": [], "annotations": [], "categories": []}


def test_export_is_whole_or_nothing(spark, tmp_path):
    from pyspark.errors import PySparkException

    rows = [(f"p{k}", 2, 2, 1, bytearray([k] * 4)) for k in range(30)]
    schema = "name string, height int, width int, nChannels int, data binary"
    d = spark.createDataFrame(rows, schema).repartition(4)
    bad = d.unionByName(spark.createDataFrame([("short", 2, 2, 1, bytearray(b"x"))], schema))
    folder = tmp_path / "out"
    with pytest.raises(PySparkException):
        sinks.export_files(bad, f"file://{folder}")
    assert not folder.exists() or list(folder.iterdir()) == []
    got = sinks.export_files(d, f"file://{folder}")
    assert sorted(r.name for r in got.collect()) == sorted(r[0] for r in rows) and sorted(p.name for p in folder.iterdir()) == sorted(f"{r[0]}.png" for r in rows)
    assert {r.path for r in got.collect()} == {f"file://{folder}/{r[0]}.png" for r in rows}
    with pytest.raises(PySparkException):
        sinks.export_files(bad, f"file://{folder}")
    assert len(list(folder.iterdir())) == 30  # what an earlier export wrote stays
    assert sinks.export_files(d.limit(2), f"file://{folder}").count() == 2 and len(list(folder.iterdir())) == 30
