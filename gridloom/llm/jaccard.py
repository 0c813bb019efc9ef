"""N-gram Jaccard join with parity sketches.

A text is its set of distinct `words`-word shingles. Its shingles are dealt by hash into pieces and
XORed together within each piece; every bit of a piece is a parity, so the Hamming distance of
two texts' sketches, and the number of pieces that differ, is at most the size of the symmetric
difference. Texts of sizes x <= y with similarity t or more differ in at most
(x + y)(1 - t) / (1 + t) shingles, which is at most d(s) = s (1 - t) / t for either size s.

Pigeonhole: each text announces its first d + 1 pieces that are not empty, in one order for all
pieces there are. At most d of a text's pieces are not the other's, so the first piece that linked
texts agree in is announced by both. Any order will do; here pieces of common shingles only (a
bounded list, of those that most often stand in several texts of a chunk) come last, so that
boilerplate is announced only by texts made of it. The list decides on work, never on results. The number of
pieces belongs to a size band, and a text near a band's lower edge announces in the band below, too. In the
first band, of texts of a few words, two shingles practically never share a piece.

Announcements travel packed: a chunk of texts sends each key once, with the text that has it. A
key that two different texts of a chunk have needs no confirmation and is sent on to no key's
task, so a task gets a key at most once for each chunk. Texts with equal sets are one class.

Candidates in rounds. In the first, all of a key's classes are paired with the smallest, which
grows as the keys do. Links are verified on the full sets and joined to components. After that, only
keys whose classes are still in different components are looked at again, in blocks of at most `block` classes:
each class is paired with the first 16 earlier classes of other components within size and Hamming bounds. Blocks
in which a class had more go on with the first 256 that were not refuted, and so on. So families of
near copies cost a few rows for each text, and only pairs that the bounds cannot tell from links are all tried.

Defined results: a text without words or null text has an empty set and is linked with nothing;
equal rows have one result; rows without an id link like all others, and may be what joins two with ids; component
ids are the smallest doc_id of the component, null if no row of it has one; component_key, a number of this run,
tells components apart whether they have ids or not (null: no shingles). Sets are known by hash: equal ones by two of 64 bits, shingles by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx
from gridloom.llm.packing import pack_sorted, unpack_sorted

#: Sizes at which a new band begins, each 16 times the last.
EDGES = np.array([16 * 16**k for k in range(9)], dtype=np.int64)
#: Pieces of the first band.
FINE = 1 << 40
SKETCH_WORDS = 16
_KEY_BITS = 48


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch as it would be with fewer words: parities add up."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def pieces_of(band: int, percent: int) -> int:
    """So many pieces that the largest sets that announce in a band still have d + 1 pieces that are not empty, and a tenth more."""
    if not band:
        return FINE
    t, many = percent / 100, 2 / 3
    while many * (1 - math.exp(-1 / (many * t))) < 1.1 * (1 - t) / t**2:
        many *= 2
    return int(EDGES[min(band, len(EDGES) - 1)] * many)


class Sets:
    """Distinct shingles of some texts, sorted within each text: text d has hashes[first[d]:first[d + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, words: int) -> None:
        h, counts = tx.word_hashes(data, bounds, tx.NOT_BLANK, tx.LOWER_BYTES)
        first = np.concatenate([[0], np.cumsum(counts)])
        of = np.repeat(np.arange(len(counts)), counts)
        room = np.repeat(first[1:], counts) - np.arange(len(h))
        runs = np.zeros(len(h), dtype=np.uint64)
        full = tx.run_hashes(h, words, words)
        runs[: len(full)] = full
        take = room >= words
        for k in range(1, words):  # a whole text of k words
            short = np.zeros(len(h), dtype=bool)
            short[first[:-1][counts == k]] = True
            some = tx.run_hashes(h, k, k)
            runs[: len(some)][short[: len(some)]] = some[short[: len(some)]]
            take |= short
        of, runs = of[take], runs[take]
        order = np.lexsort((runs, of))
        of, runs = of[order], runs[order]
        fresh = np.ones(len(runs), dtype=bool)
        fresh[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
        self.of, self.hashes = of[fresh], runs[fresh]
        self.first = np.searchsorted(self.of, np.arange(len(bounds)))
        self.sizes = np.diff(self.first)

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        out = []
        for salt in (1, 2):
            sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
            np.cumsum(tx.mix(self.hashes, salt), out=sums[1:])
            out.append((sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64))
        return out[0], out[1]

    def bit_sketches(self) -> list[np.ndarray]:
        """Parities of each set, in 64-bit words: SKETCH_WORDS, or 16 or 256 times as many for large sets."""
        wide = SKETCH_WORDS * np.where(self.sizes <= 512, 1, np.where(self.sizes <= 8192, 16, 256))
        begin = np.concatenate([[0], np.cumsum(wide)])
        bit = tx.mix(self.hashes, 3) % (wide[self.of] * 64).astype(np.uint64)
        out = np.zeros(begin[-1], dtype=np.uint64)
        np.bitwise_xor.at(out, begin[self.of] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return [out[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]

    def announced(self, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their texts: the first d + 1 pieces that are not empty, for each band of each text.

        common: sorted hashes of shingles whose pieces come last.
        """
        keys, texts = [], []
        rare = np.ones(len(self.hashes), dtype=bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, self.hashes), len(common) - 1)] != self.hashes
        need = self.sizes * (100 - percent) // percent + 1
        own = np.searchsorted(EDGES, self.sizes, side="right")
        for band in range(own.max(initial=-1) + 1):
            mine = own == band
            if band < len(EDGES):  # partners of smaller texts of this band
                mine |= (own == band + 1) & (percent * self.sizes < 100 * EDGES[band])
            mine &= self.sizes > 0
            pick = mine[self.of]
            of, h, first_half = self.of[pick], self.hashes[pick], rare[pick]
            if not len(of):
                continue
            piece = tx.mix(h, 100 + band) % np.uint64(pieces_of(band, percent))
            slot = of.astype(np.uint64) * np.uint64(pieces_of(band, percent)) + piece  # fits: many texts of a chunk are short
            order = np.argsort(slot)
            slot = slot[order]
            begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            of, first_half = of[order][begin], np.logical_or.reduceat(first_half[order], begin)
            h = tx.mix(np.bitwise_xor.reduceat(h[order], begin) ^ tx.mix(piece[order][begin]), band)
            order = np.lexsort((h, ~first_half, of))
            of, h = of[order], h[order]
            start = np.searchsorted(of, np.arange(len(self.sizes)))
            nth = np.arange(len(of)) - start[of]
            have = np.bincount(of, minlength=len(self.sizes))
            if (have[mine] < need[mine]).any():
                raise ValueError("a text has too few pieces for its size; `pieces_of` must give more")
            first = nth < need[of]
            keys.append(tx.mix(h[first], 1000 + band) >> np.uint64(64 - _KEY_BITS))
            texts.append(of[first])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(texts)


def identified(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, row_key, row_check, n, a, b (the set's identity), sketch and wide (its long form, of large sets) for each row of docs (from rows.keyed).

    again, again_n: on the first row of a chunk, shingles that several different sets of it have, and how many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches, 4 << 20):
            s = Sets(data, bounds, words)
            a, b = s.identities()
            _, index = np.unique(a, return_index=True)
            once = np.zeros(len(a), dtype=bool)
            once[index] = True
            h, many = np.unique(s.hashes[once[s.of]], return_counts=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, *[int((many > 1).sum())] * len(a)], pa.int32()), pa.array(x[many > 1])) for x in (h.view(np.int64), many)]
            long = s.bit_sketches()
            sketch = pa.array([folded(x, SKETCH_WORDS).tobytes() for x in long], pa.binary())
            wide = pa.array([x.tobytes() if len(x) > SKETCH_WORDS else None for x in long], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *rows.KEYS)), pa.array(s.sizes), pa.array(a), pa.array(b), sketch, wide, *lists], names=["doc_id", *rows.KEYS, "n", "a", "b", "sketch", "wide", "again", "again_n"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, row_key long, row_check long, n long, a long, b long, sketch binary, wide binary, again array<long>, again_n array<long>")


def common_shingles(info: DataFrame, most: int = 300_000, least: int = 8) -> np.ndarray:
    """Sorted hashes of the shingles that most often stand in several texts of a chunk, at most `most`."""
    each = info.select(F.explode(F.arrays_zip("again", "again_n")).alias("x")).groupBy(F.col("x.again").alias("h")).agg(F.sum("x.again_n").alias("n"))
    found = each.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "h").limit(most).select("h")
    return np.sort(found.toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))


def _homes(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, rising with it; by its upper 32 bits, so that the product fits 64 bits for any int of ranges."""
    return ((key >> np.uint64(_KEY_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def shared_keys(docs: DataFrame, common_list: np.ndarray, words: int, percent: int, ranges: int) -> DataFrame:
    """(key, a): the announced keys that two different sets have, with a hash of those sets (maybe repeated)."""

    common = docs.sparkSession.sparkContext.broadcast(common_list)

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches, 4 << 20):
            s = Sets(data, bounds, words)
            a, _ = s.identities()
            _, index = np.unique(a, return_index=True)
            once = np.zeros(len(a), dtype=bool)
            once[index] = True  # one text of each class speaks for it
            key, text = s.announced(percent, common.value)
            key, text = key[once[text]], text[once[text]]
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            if not len(key):
                continue
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(fresh) - 1
            many = np.bincount(group) > 1
            local = many[group]
            speaker = np.flatnonzero(fresh)
            kept_key, kept_text, known = key[speaker], text[speaker], many
            out = []
            here = int(key[0]) % ranges
            if local.any():
                out.append((here, True, pack_sorted(key[local]), text[local].astype(np.uint32).tobytes(), b"", a.tobytes()))
            for r, i, j in tx.runs_of(_homes(kept_key, ranges)):
                texts, local_of = np.unique(kept_text[i:j], return_inverse=True)
                out.append((r, False, pack_sorted(kept_key[i:j]), local_of.astype(np.uint16 if len(texts) < 65536 else np.uint32).tobytes(), np.packbits(known[i:j]).tobytes(), a[texts].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=["home", "local", "keys", "texts", "known", "who"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a home's chunks come together; homes come one after another."""
        now, parts = None, []

        def row_batch(key: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who)], names=["key", "a"])

        def settled() -> pa.RecordBatch:
            key, who, known = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key, who, known = key[order], who[order], known[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
            shared = np.logical_or.reduceat(known, begin) | (np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin))
            return row_batch(key[shared[group]], who[shared[group]])

        for batch in batches:
            for home, local, keys, texts, known, who in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, who = unpack_sorted(keys), np.frombuffer(who, np.int64)
                text = np.frombuffer(texts, np.uint32 if len(texts) == 4 * len(key) else np.uint16)
                if local:
                    yield row_batch(key, who[text])
                    continue
                if home != now:
                    if parts:
                        yield settled()
                    now, parts = home, []
                parts.append((key, who[text], np.unpackbits(np.frombuffer(known, np.uint8), count=len(key)).astype(bool)))
        if parts:
            yield settled()

    sent = docs.mapInArrow(announce, "home int, local boolean, keys binary, texts binary, known binary, who binary")
    return sent.repartition(min(ranges, rows.MOST_TASKS), "home").sortWithinPartitions("home").mapInArrow(confirm, "key long, a long")


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and Hamming distance allow the similarity."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _pairs_in_groups(members: DataFrame, refuted: DataFrame | None, percent: int, most: int) -> DataFrame:
    """(key, i, j, x, y, more): for each member at most `most` close earlier members of other components, without refuted pairs.

    more: whether a member of the group has as many, so that there may be others. members: group columns, side, vertex, label, n, sketch; refuted: group columns, x, y.
    """
    def close_pairs(group: tuple, held: list[tuple], no: set[tuple]) -> tuple[list, list, bool]:
        n, side = np.array([h[2] for h in held]), np.array([h[4] for h in held])
        _, label = np.unique(np.array([str(h[1]) for h in held]), return_inverse=True)
        sketch = np.frombuffer(b"".join(h[3] for h in held), np.uint64).reshape(len(held), SKETCH_WORDS)
        room = np.full(len(held), most)
        xs, ys = [], []
        for i in range(len(held) - 1):
            far = slice(i + 1, None)
            ok = (label[far] != label[i]) & (room[far] > 0) & ((side[far] != side[i]) | (group[1] == group[2]))
            at = np.flatnonzero(ok) + i + 1
            at = at[_close(sketch[at], sketch[i], n[at], n[i], percent)]
            if no:
                at = np.array([k for k in at.tolist() if tuple(sorted((held[i][0], held[k][0]))) not in no], dtype=np.int64)
            room[at] -= 1
            xs += [held[i][0]] * len(at)
            ys += [held[k][0] for k in at.tolist()]
        return xs, ys, not room.all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, no = None, [], set()

        def found() -> Iterator[pa.RecordBatch]:
            xs, ys, more = close_pairs(now, held, no) if len(held) > 1 else ([], [], False)
            if xs:
                columns = [pa.array([v] * len(xs), k) for v, k in zip(now, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array([more] * len(xs))], names=["key", "i", "j", "x", "y", "more"])

        for batch in batches:
            for key, i, j, side, vertex_, label, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    yield from found()
                    now, held, no = (key, i, j), [], set()
                if side < 0:
                    no.add(tuple(sorted((vertex_, label))))
                else:
                    held.append((vertex_, label, n, sketch, side))
        yield from found()

    rows_in = members.select("key", "i", "j", "side", "vertex", "label", "n", "sketch")
    if refuted is not None:
        rows_in = rows_in.unionByName(refuted.select("key", "i", "j", F.lit(-1).alias("side"), F.col("x").alias("vertex"), F.col("y").alias("label"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch")))
    pairs = rows_in.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "vertex").mapInArrow(run, "key long, i int, j int, x long, y long, more boolean")
    return pairs.select("key", "i", "j", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "more")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough; sets: vertex, items (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_items").to_pylist(), batch.column("y_items").to_pylist(), strict=True):
                p, q = unpack_sorted(x), unpack_sorted(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("vertex").alias(c), F.col("items").alias(f"{c}_items")) for c in ("x", "y"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "x_items", "y_items").mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex reachable from each end of a link (x, y); lineage is cut every round."""
    edges = rows.written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = rows.written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("vertex"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["vertex"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["vertex"] == near["x"]).select("vertex", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("vertex").alias("at"), F.col("next").alias("beyond"))
        done = step.join(jump, step["next"] == jump["at"]).select("vertex", "label", F.least("next", "beyond").alias("next"))
        done = rows.written(done, "labels")
        labels = done.select("vertex", F.col("next").alias("label"))
        if done.filter("next != label").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, block: int = 1000, range_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, row_key, row_check, n_shingles, class_id, component_id and component_key for each row of docs; rows with equal sets are one vertex."""
    if percent < 60:
        raise ValueError("percent must be 60 or more: below, sketches of the size of the sets leave too little to agree in")
    keyed = rows.keyed(docs, id_col, text_col)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    info = rows.written(identified(keyed, words), "sets")
    classes = info.filter("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *rows.KEYS)).alias("first"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    # Vertices are numbered as their first rows sort, by id: what copies were made of tends to come first, and is what they are paired with first.
    order = [f"first.{c}" for c in ("nameless", "doc_id", *rows.KEYS)]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("vertex", F.monotonically_increasing_id())
    classes = rows.written(classes.select("a", "b", "n", F.col("first.doc_id").alias("class_id"), "first.row_key", "first.row_check", "sketch", "wide", "vertex"), "classes")
    announced = shared_keys(keyed, common_shingles(info), words, percent, max(1, math.ceil(size / range_bytes)))
    keys = announced.distinct().join(classes.select("a", "vertex", "n"), "a")  # equal hashes of unlike sets only make more candidates
    keys = rows.written(keys.select("key", "vertex", "n"), "keys")

    def verified(pairs: DataFrame, step: int) -> DataFrame:
        """Only the sets that are in a pair are made and sent."""
        pairs = rows.written(pairs, f"pairs-{step}")
        ends = pairs.select(F.col("x").alias("vertex")).unionByName(pairs.select(F.col("y").alias("vertex"))).distinct()
        wanted = rows.written(ends.join(classes.select("vertex", *rows.KEYS), "vertex").select(*rows.KEYS, "vertex"), f"wanted-{step}")
        sets = rows.written(_packed_sets(rows.wanted_texts(keyed, wanted), words).dropDuplicates(["vertex"]), f"items-{step}")  # equal rows are one
        return _verified(pairs, sets, percent)

    leaders = keys.groupBy("key").agg(F.min("vertex").alias("x"), F.min_by("n", "vertex").alias("m"))
    star = rows.join_hot(keys, leaders, ["key"]).filter(f"vertex != x and 100 * least(n, m) >= {percent} * greatest(n, m)").select("x", F.col("vertex").alias("y")).distinct()
    sketches = classes.select("vertex", "n", F.coalesce("wide", "sketch").alias("sketch"))
    links = rows.written(verified(_within_bounds(star, sketches, percent), 1), "links-1")
    labels = components(links)

    named = keys.join(labels, "vertex", "left").select("key", "vertex", "n", F.coalesce("label", "vertex").alias("label"))
    named = rows.written(named, "named")
    # Keys of the same classes need only one look; a group is known by two hashes of its members.
    alike = [F.bit_xor(F.xxhash64("vertex", F.lit(salt))).alias(f"members_{salt}") for salt in (1, 2)]
    open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("g"), *alike).filter("low != high")
    open_keys = open_keys.groupBy("g", "members_1", "members_2").agg(F.min("key").alias("key")).select("key", "g")
    member = rows.join_hot(named.drop("label"), open_keys, ["key"])
    blocks = F.ceil(F.col("g") / F.lit(block)).cast("int")
    member = member.withColumn("side", F.pmod(F.xxhash64("vertex"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    member = member.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    refuted = None
    for step in count(1):
        of = classes.select("vertex", "sketch").join(labels, "vertex", "left").select("vertex", "sketch", F.coalesce("label", "vertex").alias("label"))
        found = rows.written(_pairs_in_groups(member.join(of, "vertex"), refuted, percent, 16**step), f"found-{step}")
        linked = rows.written(verified(_within_bounds(found.select("x", "y").distinct(), sketches, percent), step + 1), f"links-{step}")
        if not linked.isEmpty():
            links = links.unionByName(linked)
            labels = components(links)
        more = rows.written(found.filter("more").select("key", "i", "j").distinct(), f"more-{step}")
        if more.isEmpty():
            break
        wrong = found.join(more, ["key", "i", "j"], "left_semi").join(linked, ["x", "y"], "left_anti").drop("more")
        refuted = wrong if refuted is None else refuted.join(more, ["key", "i", "j"], "left_semi").unionByName(wrong)
        refuted = rows.written(refuted, f"refuted-{step}")
        member = rows.written(member.join(more, ["key", "i", "j"], "left_semi"), f"members-{step}")

    of = classes.select("a", "b", "class_id", "vertex").join(labels, "vertex", "left").select("a", "b", "class_id", F.coalesce("label", "vertex").alias("component_key"))
    of = rows.written(of, "components")
    smallest = of.groupBy("component_key").agg(F.min("class_id").alias("component_id"))
    out = info.join(rows.join_hot(of, smallest, ["component_key"]), ["a", "b"], "left")
    mine = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", *rows.KEYS, F.col("n").alias("n_shingles"), mine("class_id"), mine("component_id"), "component_key")


def _packed_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches):
            s = Sets(data, bounds, words)
            items = [pack_sorted(s.hashes[s.first[d] : s.first[d + 1]]) for d in range(len(s.sizes))]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(items, pa.binary())], names=["vertex", "items"])

    return texts.mapInArrow(run, "vertex long, items binary")


def _within_bounds(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and Hamming distance allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x_sketch", "y_sketch", "x_n", "y_n")), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(p), len(q))
                keep.append(bool(_close(folded(p, words), folded(q, words), n, m, percent)))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sketches.select(F.col("vertex").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in ("x", "y"))
    return pairs.join(one, "x").join(two, "y").mapInArrow(run, "x long, y long")
