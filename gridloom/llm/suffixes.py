"""Suffix-array dedup: bytes in a string of `window` bytes that also starts elsewhere are removed.

A sparse suffix array: of every window the `gram`-byte string of least hash is its anchor, so
equal windows have equal anchors at equal offsets, and one position in about (window - gram) / 2
is one. Anchors whose hash occurs once cannot be in a repeated window and go no further. Those
whose contexts (the bytes a window around them can span) are all equal are repeated as far as
these go. The contexts of the others are dealt into four families by the offset of their windows. Those
that agree in all bytes the windows of a family span (its hull) have all these windows in common.
Of each hull one context goes on, and those that agree in the bytes all windows of a family have
(its core) meet in a task.

There the contexts of an anchor are suffixes to its right and, read backwards, to its left.
Both are merge-sorted; two suffixes are compared by a binary search over their prefix
polynomial hashes for the common extension and by the byte behind it, and the extension is then
checked on the bytes. Walking the longest common prefixes of the right order from long to
short and joining the smaller set to the larger, neighbours in the left order give each context
its longest repeated stretch to either side; stretches shorter than a window do not count.

A core with more than `most_contexts` different hulls is not gathered: its families are halved, and
the narrower ones are dealt out in the same way by their larger cores. A family of one window has
its core for hull, so this ends after log2(window - gram) rounds at most, and is exact.

Extensions are checked on bytes. That contexts of one anchor, or hulls of one core, are copies as a whole is
decided by a hash of 62 bits alone (two points modulo a prime), beside that of the anchor or core, as their bytes
would be several times the input to send.

Defined results: a null text is an empty one; rows with equal id and text are copies of each
other, whose places are kept once; rows of one id with different texts are different documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cmp_to_key, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx
from gridloom.llm.substrings import _owners, least_runs, selected

CHUNK = 1 << 18
#: What names a context: the hashes of its anchor and of all its bytes.
_CONTEXT = ("anchor", "context")
_RANDOM = np.random.default_rng(3_310_559)
#: Each byte as an item of runs.
_ITEMS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Of the prefix hashes, modulo 2**64: what they find is checked on bytes.
_PREFIX = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POINT = np.uint64(0xD6E8FEB86659FD93)


class SortedSuffixes:
    """Strings in order, with common extensions by prefix hashes."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.wide = int(self.lengths.max(initial=0))
        raw = np.frombuffer(b"".join(s.ljust(self.wide, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), self.wide)
        self.prefix = np.zeros((len(strings), self.wide + 1), dtype=np.uint64)
        powers = np.multiply.accumulate(np.full(self.wide, _POINT))
        np.cumsum(_PREFIX[raw] * powers, axis=1, out=self.prefix[:, 1:])

    def common(self, i: int, j: int) -> int:
        """Length of the longest common prefix of strings i and j."""
        a, b, p, q = self.strings[i], self.strings[j], self.prefix[i], self.prefix[j]
        low, high = 0, min(len(a), len(b))
        if p[high] == q[high]:
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if p[mid] == q[mid] else (low, mid - 1)
        if a[:low] != b[:low]:  # equal hashes of different bytes
            low = next(k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
        return low

    def _compare(self, i: int, j: int) -> int:
        n = self.common(i, j)
        a, b = self.strings[i], self.strings[j]
        if n == len(a) or n == len(b):
            return (len(a) - len(b)) or (i - j)
        return -1 if a[n] < b[n] else 1

    def order(self) -> list[int]:
        """Indices of the strings, merge-sorted."""
        return sorted(range(len(self.strings)), key=cmp_to_key(self._compare))


def longest_matches(left: list[bytes], right: list[bytes], window: int) -> tuple[list[int], list[int]]:
    """For each context, how far to the left and right of its anchor the windows reach that another context has too.

    left: the bytes before the anchor, backwards; right: those from it on. (0, 0) if there is no such window.
    """
    n = len(left)
    lefts, rights = SortedSuffixes(left), SortedSuffixes(right)
    most_left, most_right = [0] * n, [0] * n

    def meet(i: int, j: int, ahead: int) -> None:
        behind = lefts.common(i, j)
        if behind + ahead >= window:
            for x in (i, j):
                most_left[x], most_right[x] = max(most_left[x], behind), max(most_right[x], ahead)

    if n == 2:
        meet(0, 1, rights.common(0, 1))
        return most_left, most_right
    order = rights.order()
    shared = [rights.common(order[k], order[k + 1]) for k in range(n - 1)]
    place = [0] * n
    by_left = lefts.order()
    for k, i in enumerate(by_left):
        place[i] = k
    group, members = list(range(n)), [[place[i]] for i in range(n)]

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for k in sorted(range(n - 1), key=shared.__getitem__, reverse=True):
        small, large = top(order[k]), top(order[k + 1])
        if len(members[small]) > len(members[large]):
            small, large = large, small
        into = members[large]
        for p in members[small]:
            at = bisect_left(into, p)
            for q in into[max(at - 1, 0) : at + 1]:
                meet(by_left[p], by_left[q], shared[k])
        for p in members[small]:
            insort(into, p)
        members[small], group[small] = [], large
    return most_left, most_right


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row_key, row_check, anchor, place, context, after): each document's anchors.

    anchor: hash of the anchor's bytes; context: of the bytes a window around it can span, of which min(place, window - gram)
    precede it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches, CHUNK):
            room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
            runs, least, full = least_runs(_ITEMS[data], room, gram, window)
            at = selected(runs, least, full, window - gram + 1)
            if not len(at):
                continue
            of = np.searchsorted(bounds, at, side="right") - 1
            lo, hi = np.maximum(bounds[of], at - (window - gram)), np.minimum(bounds[of + 1], at + window)
            context = tx.mix(tx.span_hashes(data, lo, hi) ^ tx.mix((at - lo).astype(np.uint64)))
            mine = batch.select(list(rows.KEYS)).take(pa.array(of))
            columns = [*mine.columns, pa.array(runs[at].view(np.int64)), pa.array((at - bounds[of]).astype(np.int32)), pa.array(context.view(np.int64)), pa.array((hi - at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.KEYS, "anchor", "place", "context", "after"])

    return docs.mapInArrow(run, "row_key long, row_check long, anchor long, place int, context long, after int")


def _spelled(docs: DataFrame) -> DataFrame:
    """The bytes of the contexts listed in column `wanted`, once for equal rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for every, data, bounds in rows.text_chunks(batches, CHUNK):
            names = list(zip(*(every.column(k).to_pylist() for k in rows.KEYS), strict=True))
            fresh = [k for k, name in enumerate(names) if name not in seen and not seen.add(name)]
            batch, bounds = every.take(pa.array(fresh, pa.int64())), bounds[fresh]
            wanted = batch.column("wanted")
            of, flat = _owners(wanted), wanted.flatten()
            at = bounds[of] + flat.field("place").to_numpy()
            lo, hi = at - flat.field("before").to_numpy(), at + flat.field("after").to_numpy()
            raw = data.tobytes()
            around = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in (*_CONTEXT, "before")), around], names=[*_CONTEXT, "before", "around"])

    return docs.mapInArrow(run, "anchor long, context long, before int, around binary")


_REACH = "id long, reach_left int, reach_right int"
_ANSWER = pa.schema([("id", pa.int64()), ("reach_left", pa.int32()), ("reach_right", pa.int32())])


def _matched(contexts: DataFrame, group: str, window: int) -> DataFrame:
    """(id, reach_left, reach_right): how far contexts are repeated in others of their group; a group's contexts stand together in a partition."""

    def answers(held: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
        reach = longest_matches([h[2][: h[1]][::-1] for h in held], [h[2][h[1] :] for h in held], window)
        return [(h[0], a, b) for h, a, b in zip(held, *reach, strict=True) if a + b >= window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    out += answers(held) if len(held) > 1 else []
                    now, held = key, []
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)
                out = []
        if len(held) > 1 and (out := answers(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)

    one = contexts.select(F.col(group).alias("group"), "id", "before", "around")
    return one.repartition("group").sortWithinPartitions("group").mapInArrow(run, _REACH)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, bytes of column `around` and their bounds, a chunk at a time."""
    for batch in batches:
        data, bounds = tx.flat(batch.column("around").cast(pa.large_binary()))
        for i, j in tx.chunked(bounds, CHUNK):
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def _nodes(contexts: DataFrame, window: int, parts: int) -> DataFrame:
    """(core, hull, id, low, high, least_back, most_back): each context's windows, dealt into families.

    A row's windows begin low to high bytes before the anchor; these are cut into `parts` families.
    core: hash of the bytes all windows of the family have; hull: of those at least one has;
    least_back, most_back: where windows of the family begin that the document has room for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in _around(batches):
            spans = tx.Spans(data)
            anchor, name, before, low, high = (batch.column(c).to_numpy() for c in ("anchor", "id", "before", "low", "high"))
            start, end, at = bounds[:-1], bounds[1:], bounds[:-1] + before
            step = -(-(high - low + 1) // parts)
            for part in range(parts):
                first = low + part * step
                last = np.minimum(first + step - 1, high)
                least, most = np.maximum(first, window - (end - at)), np.minimum(last, before)
                fits = np.flatnonzero((first <= last) & (least <= most) & (at - first >= start) & (at + window - last <= end))
                one, f, t = at[fits], first[fits], last[fits]
                family = tx.mix(anchor[fits].view(np.uint64) ^ tx.mix((f * (window + 1) + t).astype(np.uint64)))
                core = tx.mix(spans.hashes(one - f, one + window - t) ^ family)
                lo, hi = np.maximum(one - t, start[fits]), np.minimum(one + window - f, end[fits])
                hull = tx.mix(spans.hashes(lo, hi) ^ tx.mix((one - lo).astype(np.uint64)))
                columns = [core.view(np.int64), hull.view(np.int64), name[fits], *(c.astype(np.int32) for c in (f, t, least[fits], most[fits]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "hull", "id", "low", "high", "least_back", "most_back"])

    return contexts.mapInArrow(run, "core long, hull long, id long, low int, high int, least_back int, most_back int")


def _in_several(contexts: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """How far each of the contexts is repeated in others of its anchor."""
    found, parts = [], 4
    contexts = rows.written(contexts.withColumn("id", F.monotonically_increasing_id()), "spelled")
    todo = contexts.withColumns({"low": F.lit(0), "high": F.lit(window - gram)})
    while True:
        nodes = rows.written(_nodes(todo, window, parts), "nodes")
        one = F.min(F.struct("id", "low", "high")).alias("one")
        hulls = rows.written(nodes.groupBy("core", "hull").agg(F.count("*").alias("n"), one).select("core", "hull", "n", "one.*"), "hulls")
        same = rows.join_hot(nodes, hulls.filter("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
        found.append(same.select("id", F.col("most_back").alias("reach_left"), (window - F.col("least_back")).alias("reach_right")))
        sizes = rows.written(hulls.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1"), "cores")
        held = rows.join_hot(hulls, sizes, ["core"]).select("core", "m", "id", "low", "high")
        wider = todo.withColumnsRenamed({"low": "from_low", "high": "from_high"})  # a family lies in one that was cut
        held = held.join(wider, "id").filter("low between from_low and from_high").drop("from_low", "from_high")
        found.append(_matched(held.filter(F.col("m") <= most), "core", window))
        if sizes.filter(F.col("m") > most).isEmpty():
            reach = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("reach_left").alias("reach_left"), F.max("reach_right").alias("reach_right"))
            return contexts.select("id", *_CONTEXT).join(reach, "id").drop("id")
        todo, parts = rows.written(held.filter(F.col("m") > most).drop("core", "m"), "crowded"), 2


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = 200, most_contexts: int = 1000) -> DataFrame:
    """docs (from rows.keyed, packed) with column spans: (start, end) byte stretches to remove, which may overlap."""
    texts = rows.packed(docs)
    every = rows.new_folder(docs.sparkSession, "anchors")
    placed = rows.written(anchors(docs, window, gram), "anchors", every)
    twice = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    found = rows.written(rows.join_hot(placed, twice, ["anchor"], "left_semi"), "found")
    rows.delete(docs.sparkSession, every)
    where = F.struct(*rows.KEYS, "place", F.least("place", F.lit(window - gram)).alias("before"), "after")
    different = rows.written(found.groupBy(*_CONTEXT).agg(F.count("*").alias("n"), F.min(where).alias("at")).select(*_CONTEXT, "n", "at.*"), "different")
    counts = rows.written(different.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "counts")
    # A context that occurs twice is repeated as far as it goes. Only where an anchor has several, their bytes are needed.
    whole = different.filter((F.col("n") > 1) & (F.col("before") + F.col("after") >= window))
    reach = whole.select(*_CONTEXT, F.col("before").alias("reach_left"), F.col("after").alias("reach_right"))
    several = different.join(counts, "anchor", "left_semi").groupBy(*rows.KEYS).agg(F.collect_list(F.struct(*_CONTEXT, "place", "before", "after")).alias("wanted"))
    spelled = _spelled(rows.with_info(texts, several, "inner"))
    reach = reach.unionByName(_in_several(spelled, window, gram, most_contexts))
    reach = reach.groupBy(*_CONTEXT).agg(F.max("reach_left").alias("reach_left"), F.max("reach_right").alias("reach_right"))
    spans = rows.join_hot(found.select(*rows.KEYS, *_CONTEXT, "place"), reach, list(_CONTEXT))
    spans = spans.groupBy(*rows.KEYS).agg(F.collect_set(F.struct((F.col("place") - F.col("reach_left")).alias("start"), (F.col("place") + F.col("reach_right")).alias("end"))).alias("spans"))
    return rows.with_info(texts, spans)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 200, most_contexts: int = 1000, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if with_bytes) kept_bytes for each row of docs."""
    d = repeated_spans(rows.keyed(docs, id_col, text_col), window, gram, most_contexts)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches, CHUNK):
            out = []
            for t, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[bounds[t] : bounds[t + 1]].tobytes()
                kept, at, gone = [], 0, 0
                end = -1
                for s, e in sorted((s["start"], s["end"]) for s in spans or ()):
                    if s > end:
                        if end >= 0:
                            at = end
                        kept.append(raw[at:s])
                        gone += 1
                        end = e
                    end = max(end, e)
                kept.append(raw[end:] if end >= 0 else raw)
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), gone, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[: len(names) - 1]], names=names)

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
