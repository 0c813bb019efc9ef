"""WARC archives: a deterministic sharded writer and a reader.

Pages are sorted by (page_id, payload digest, hash of the url) and cut into shards of about `shard_bytes` of payload and
headers: a range sort of these keys and sizes alone gives the running sums that name each shard's first key, so
the same pages give the same shards, whatever the partitions. Payloads then go to the partition
of their shard's number, each shard to one of its own, are sorted there, and files are closed at
`file_bytes` compressed. Every record is a gzip member of its own, with headers and digests made anew.

Commit: a task writes its files under temporary names, renames them when its shard is whole, and
last renames the shard's own manifest into place. The names follow from the shard, so an
attempt that is repeated replaces equal files. The driver only adds up what the tasks did, writes the
archive's manifest (counts), and removes what killed attempts left. Without it a folder is no archive.

Of pages with equal payloads of at least `revisit_bytes`, that with the largest page_id holds
the payload, the others are revisit records that refer to it. Who refers to whom is found on
digests alone and merged into the sorted stream, so payloads are shuffled once.

Defined results: a null payload is an empty one; a null page_id sorts first, is never what others refer to, and refers to the page
that others with its payload refer to, if one of them has an id; repeated rows of the referred page all stay responses; a null url is written as
`urn:page:<id>`; further columns are not archived; rows of one page_id may be in several shards, but for those
equal in id, payload and url, which are in one and written as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import rows

_NEWLINE = b"\r\n"
#: What a record counts in its shard beside its payload.
HEADER_BYTES = 512
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, part long, path string, records long, bytes long, sha256 string"
_COUNTS = "shards long, files long, records long, bytes long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + _NEWLINE


def build_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member; a revisit has the HTTP headers only."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if is_revisit else payload
    name = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", name),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"), ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if is_revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without a time stamp
    return pack.compress(_header(fields) + block + _NEWLINE * 2) + pack.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises if the block does not match its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def _keys(page_id: np.ndarray, named: np.ndarray, *hexes: list[str]) -> np.ndarray:
    """Fixed-width keys that sort like (page_id, nulls first, and hex digests)."""
    ids = (np.where(named, page_id, 0).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    parts = [named.astype(np.uint8)[:, None] + np.uint8(1), ids.view(np.uint8).reshape(-1, 8), *(np.frombuffer("".join(h).encode(), np.uint8).reshape(len(ids), -1) for h in hexes)]
    wide = np.ascontiguousarray(np.hstack(parts)) if len(ids) else np.zeros((0, 81), np.uint8)
    return wide.view(f"S{wide.shape[1]}").ravel()


def _shard_bounds(pages: DataFrame, shard_bytes: int, most_shards: int) -> np.ndarray:
    """The first key of each shard but the first; pages: page_id, digest, place (hash of the url), size."""
    size = pages.agg(F.sum("size")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-size // most_shards))
    if size <= shard_bytes:
        return _keys(np.zeros(0, np.int64), np.zeros(0, bool))
    keys = [F.col("page_id").asc_nulls_first(), F.col("digest"), F.col("place")]
    sized = pages.groupBy("page_id", "digest", "place").agg(F.sum("size").alias("size"))
    ranged = rows.written(sized.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("sum"))  # one row for each shuffle partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    ahead = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    shard = F.floor((F.col("start") + F.col("within")) / F.lit(shard_bytes))
    first = within.join(starts, "range").withColumn("shard", shard).groupBy("shard").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "digest", "place")).alias("key"))
    found = first.select("key.*").collect()
    return np.sort(_keys(np.array([r["page_id"] or 0 for r in found]), np.array([r["named"] for r in found]), [r["digest"] for r in found], [r["place"] for r in found]))[1:]


class _Shard:
    """Rolls the files of one shard under temporary names; commit() gives them their own."""

    def __init__(self, folder: str, shard: int, file_bytes: int) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.file_bytes, self.attempt = shard, file_bytes, uuid.uuid4().hex
        self.stream, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.stream is not None and self.size >= self.file_bytes:
            self._close()
        if self.stream is None:
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
            self.name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.stream = self.fs.open_output_stream(self._temporary(self.name), compression=None)
        self.stream.write(record)
        self.sum.update(record)
        self.size, self.records = self.size + len(record), self.records + 1

    def _temporary(self, name: str) -> str:
        return f"{self.path}/_temporary/{name}-{self.attempt}"

    def _close(self) -> None:
        self.stream.close()
        self.stream = None
        self.done.append({"shard": self.shard, "part": len(self.done), "path": self.name, "records": self.records, "bytes": self.size, "sha256": self.sum.hexdigest()})

    def commit(self) -> tuple[int, int, int, int]:
        self._close()
        for f in self.done:
            self.fs.move(self._temporary(f["path"]), f"{self.path}/{f['path']}")
        name = _shard_manifest(self.shard)
        with self.fs.open_output_stream(self._temporary(name)) as out:
            out.write(json.dumps(self.done, indent=1).encode())
        self.fs.move(self._temporary(name), f"{self.path}/{name}")
        return 1, len(self.done), sum(f["records"] for f in self.done), sum(f["bytes"] for f in self.done)


def _shard_manifest(shard: int) -> str:
    return f"manifest-{shard:06d}.json"


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", most_shards: int = 100_000) -> dict[str, int]:
    """Write pages (page_id, url, html) as WARC files under `folder`, a new one; returns numbers of shards, files, records and bytes.

    most_shards: bounds what the driver and each task hold of shard bounds; larger tables have larger shards.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{path}/manifest.json").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} is an archive already")
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir_contents(path)  # what a writer that was killed has left
    fs.create_dir(f"{path}/_temporary", recursive=True)

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digest, place = F.sha1("payload").alias("digest"), F.md5(F.coalesce("url", F.lit(""))).alias("place")
    slim = p.select("page_id", digest, place, F.octet_length("payload").cast("long").alias("payload_bytes"))
    bounds = _shard_bounds(slim.withColumn("size", F.col("payload_bytes") + HEADER_BYTES), shard_bytes, most_shards)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series, place: pd.Series) -> pd.Series:
        keys = _keys(page_id.fillna(0).to_numpy(dtype=np.int64), page_id.notna().to_numpy(), digest.tolist(), place.tolist())
        return pd.Series(np.searchsorted(bounds, keys, side="right").astype(np.int32))

    # Who refers to whom, on digests; these rows go to all shards that hold rows of their pages, and sort right before them.
    slim = slim.filter(F.col("payload_bytes") >= revisit_bytes)
    kept = slim.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    refers = rows.join_hot(slim, kept, ["digest", "payload_bytes"]).filter("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    shards = F.sequence(shard_of("page_id", "digest", F.lit("0" * 32)), shard_of("page_id", "digest", F.lit("f" * 32)))
    refers = refers.withColumn("shard", F.explode(shards))
    stream = p.select("page_id", digest, place, F.lit(None).cast("long").alias("refers_to"), "url", "payload").withColumn("shard", shard_of("page_id", "digest", "place")).drop("place")
    stream = stream.unionByName(refers.select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "shard"))
    stream = stream.repartitionById(len(bounds) + 1, "shard")
    stream = stream.sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").desc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, target = None, None
        for batch in batches:
            for page_id, digest, refers_to, url, payload, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = shard or _Shard(folder, number, file_bytes)
                if payload is None:
                    target = (page_id, digest, refers_to)
                    continue
                revisit = target is not None and target[:2] == (page_id, digest)
                shard.add(build_record(page_id, url, payload, date, target[2] if revisit else None, revisit))
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in shard.commit()], names=["shards", "files", "records", "bytes"])

    made = stream.mapInArrow(run, _COUNTS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("shards", "files", "records", "bytes"))).first().asDict()
    with fs.open_output_stream(f"{path}/_temporary/manifest") as out:
        out.write(json.dumps(made, indent=1).encode())
    fs.move(f"{path}/_temporary/manifest", f"{path}/manifest.json")
    fs.delete_dir(f"{path}/_temporary")
    return made


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file of the archive, from the shards' manifests, read by tasks."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                with here.open_input_stream(f"{root}/{_shard_manifest(shard)}") as f:
                    yield pa.RecordBatch.from_pylist(json.loads(f.read()))

    return spark.range(0, shards, 1, max(1, shards)).mapInArrow(run, _MANIFEST)


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one at a time."""
    pack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(pack.decompress(data))
            data = pack.unused_data
            if pack.eof:
                yield b"".join(parts)
                pack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends within a record")


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the files in the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, root = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("path").to_pylist():
                out, size = [], 0
                with here.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        h, block = parse_record(raw)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        whole = h["WARC-Type"] == "response"
                        if whole and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload in {name}")
                        full = int(head.rsplit(b"Content-Length: ", 1)[1])
                        refers = h.get("Refers-To-Page-ID")
                        out.append((int(h["Page-ID"]) if h["Page-ID"] else None, full, digest, h["WARC-Type"], int(refers) if refers else None, h["WARC-Target-URI"], name, payload if whole and with_payload else None))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return read_manifest(spark, folder).mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, **how: object) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back."""
    folder = rows.new_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, **how)
    return read_archive(pages.sparkSession, folder, with_payload=False).drop("payload")
