"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, normalised to words, become automata of about `block_words` words, each built by a task and kept
as a few sorted arrays. Documents stream past as many of them as `resident_words` allows, which bounds what is
broadcast and what a task holds; larger sets of items take several passes, whose hits are
merged by document. At each word the automaton's state
gives the longest run of words ending there that also stands in an item. Runs of `window` words
or more are hits, and so is a whole shorter item. Only stretches in which every pair of
neighbouring words stands in some item are stepped through; the others cannot hold a window.

Defined results: a null text has no words, is not contaminated and stays null; items without
words never match; a null item_id counts as the empty string; repeated rows are judged row by row.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import rows
from gridloom.llm import text as tx


class _Moves:
    """States of a suffix automaton while it grows."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, c: int, to: int) -> int:
        """The state for `state` followed by c: `to`, or a shorter copy of it."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._add(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(c) == to:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, state = self._add(self.length[last] + 1, {}, 0), last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, c, self.next[state][c])
        return new

    def shortest(self, state: int, window: int) -> int:
        """The state of the last `window` words of a match that ends in this state."""
        while self.length[self.link[state]] >= window:
            state = self.link[state]
        return state


def _lists(of: dict[int, Iterable[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, and the list of the k-th key as values[first[k]:first[k + 1]]."""
    keys = sorted(of)
    values = [list(of[k]) for k in keys]
    return np.array(keys, np.int64), np.cumsum([0, *map(len, values)]), np.array([x for v in values for x in v], np.int64)


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.window = window
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)]))
        coded = [(name, np.searchsorted(self.vocab, h).tolist()) for name, h in items if len(h)]
        moves = _Moves()
        for _, words in coded:
            last = 0
            for c in words:
                last = moves.extend(last, c)
        self.least = min([window, *(len(w) for _, w in coded)], default=window)
        self.many = max(len(self.vocab), 1)
        self.pairs = np.unique(np.array([a * self.many + b for _, w in coded for a, b in zip(w, w[1:], strict=False)], dtype=np.int64))
        self.names = [name for name, _ in coded]
        windows: dict[int, set[int]] = {}  # state of a full window -> items
        whole: dict[int, list[tuple[int, int]]] = {}  # state of a whole short item -> (words, item)
        for item, (_, words) in enumerate(coded):
            state = 0
            for i, c in enumerate(words):
                state = moves.next[state][c]
                if i + 1 >= window:
                    windows.setdefault(moves.shortest(state, window), set()).add(item)
            if len(words) < window:
                whole.setdefault(state, []).append((len(words), item))
        marked = [-1] * len(moves.next)  # the nearest state with a short item up the suffix links
        for state in sorted(range(1, len(moves.next)), key=moves.length.__getitem__):
            marked[state] = state if state in whole else marked[moves.link[state]]
        keys = np.array([state * self.many + c for state, to in enumerate(moves.next) for c in to], dtype=np.int64)
        targets = np.array([t for to in moves.next for t in to.values()], dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]
        self.link, self.length, self.marked = (np.array(x, dtype=np.int32) for x in (moves.link, moves.length, marked))
        self.window_state, self.window_first, self.window_items = _lists(windows)
        self.whole_state, self.whole_first, self.whole_items = _lists({state: [x for pair in pairs for x in pair] for state, pairs in whole.items()})

    def step(self, state: int, c: int) -> int:
        """The state after c, or -1."""
        key = state * self.many + c
        at = int(np.searchsorted(self.keys, key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def _items_of_window(self, state: int) -> list[int]:
        """Of the last `window` words of a match that ends in this state."""
        while self.length[self.link[state]] >= self.window:
            state = int(self.link[state])
        at = int(np.searchsorted(self.window_state, state))
        return self.window_items[self.window_first[at] : self.window_first[at + 1]].tolist()

    def _whole_items(self, state: int) -> Iterator[tuple[int, int]]:
        """(words, item) of the short items that end a match in this state, longest states first."""
        state = int(self.marked[state])
        while state > 0:
            at = int(np.searchsorted(self.whole_state, state))
            flat = self.whole_items[self.whole_first[at] : self.whole_first[at + 1]].tolist()
            yield from zip(flat[::2], flat[1::2], strict=True)
            state = int(self.marked[self.link[state]])

    def stretches(self, w: tx.Words, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges that can hold a window."""
        known = codes >= 0
        pair = known[:-1] & known[1:] & (w.room()[:-1] > 1)
        at = np.flatnonzero(pair)
        pair[at] = np.isin(codes[at] * self.many + codes[at + 1], self.pairs)
        change = np.diff(np.concatenate([[0], pair.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        good = ends - starts >= self.least - 1
        yield from zip(starts[good].tolist(), (ends[good] + 1).tolist(), strict=True)
        if self.least == 1:
            alone = known.copy()
            alone[:-1] &= ~pair
            alone[1:] &= ~pair
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def hits(self, w: tx.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are in an occurrence of a window, and the items of each text."""
        hit, found = np.zeros(len(w), dtype=bool), {}
        if not len(w) or not len(self.vocab):
            return hit, found
        h = w.hashes(tx.LOWER_BYTES)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        codes = np.where(self.vocab[at] == h, at, -1)
        text_of = w.text_of()
        for start, end in self.stretches(w, codes):
            state = run = 0
            items: set[int] = set()
            for i, c in enumerate(codes[start:end].tolist(), start):
                to = self.step(state, c)
                while state and to < 0:
                    state = int(self.link[state])
                    run = int(self.length[state])
                    to = self.step(state, c)
                if to >= 0:
                    state, run = to, run + 1
                if run >= self.window:
                    hit[i - run + 1 : i + 1] = True
                    items.update(self._items_of_window(state))
                for words, item in self._whole_items(state):
                    if words <= run:
                        hit[i - words + 1 : i + 1] = True
                        items.add(item)
            if items:
                found.setdefault(int(text_of[start]), set()).update(items)
        return hit, found


def item_words(names: list[str | None], texts: pa.Array) -> list[tuple[str, np.ndarray]]:
    data, bounds = tx.flat(texts)
    w = tx.Words(data, bounds, tx.ALNUM)
    h = w.hashes(tx.LOWER_BYTES)
    return [(n or "", h[w.first[i] : w.first[i + 1]]) for i, n in enumerate(names)]


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """(words, automaton): a written table of pickled automata of about block_words words each, made by tasks."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word has two bytes at least, with its blank
    of = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    grouped = items.groupBy(of.alias("block")).agg(F.collect_list(F.struct("item_id", "text")).alias("items")).select("items")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("items").slice(k, 1).flatten()
                words = item_words(own.field("item_id").to_pylist(), own.field("text"))
                many = sum(len(w) for _, w in words)
                yield pa.RecordBatch.from_arrays([pa.array([many]), pa.array([pickle.dumps(ItemAutomaton(words, window), 5)], pa.binary())], names=["words", "automaton"])

    return rows.written(grouped.mapInArrow(build, "words long, automaton binary").withColumn("block", F.monotonically_increasing_id()), "automata")


def _groups(automata: DataFrame, resident_words: int) -> Iterator[list[ItemAutomaton]]:
    """The automata, so many at a time that they have at most resident_words words (or are one)."""
    group, size = [], 0
    for r in [*automata.select("block", "words").orderBy("block").collect(), None]:
        if group and (r is None or size + r["words"] > resident_words):
            yield [pickle.loads(x["automaton"]) for x in automata.filter(F.col("block").isin(group)).select("automaton").collect()]
            group, size = [], 0
        if r is not None:
            group.append(r["block"])
            size += r["words"]


def _without(data: np.ndarray, w: tx.Words, hit: np.ndarray, text: int, lo: int, hi: int) -> str:
    """A text without the stretches of words that are hit, blanks within a stretch included."""
    i, j = int(w.first[text]), int(w.first[text + 1])
    change = np.diff(np.concatenate([[0], hit[i:j].astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(change == 1) + i, np.flatnonzero(change == -1) + i
    raw, parts, at = data[lo:hi].tobytes(), [], 0
    for s, e in zip(w.starts[starts] - lo, w.ends[ends - 1] - lo, strict=True):
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace")


_ADDED = T.StructType([T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("cleaned", T.StringType()))])


def _hits(automata: list[ItemAutomaton], w: tx.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and the names of the items of each text."""
    hit, items = np.zeros(len(w), dtype=bool), {}
    for a in automata:
        more, found = a.hits(w)
        hit |= more
        for text, which in found.items():
            items.setdefault(text, set()).update(a.names[i] for i in which)
    return hit, items


def _judged(data: np.ndarray, w: tx.Words, hit: np.ndarray, items: dict[int, set[str]], clean: bool) -> list[tuple]:
    out = []
    for text, (n, bad) in enumerate(zip(w.counts.tolist(), tx.per_text(hit, w.first).tolist(), strict=True)):
        mine = sorted(items.get(text, ()))
        row = (n, bad, len(mine), hashlib.sha256(",".join(mine).encode()).hexdigest(), bad > 0)
        out.append((*row, _without(data, w, hit, text, int(w.bounds[text]), int(w.bounds[text + 1])) if bad and clean else None))
    return out


def _hits_by_document(docs: DataFrame, automata: list[ItemAutomaton], name: str) -> DataFrame:
    """(row_key, row_check, starts, ends, items) of the documents (from rows.keyed) with hits: stretches of words that are hit."""
    held = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches):
            w = tx.Words(data, bounds, tx.ALNUM)
            hit, items = _hits(held.value, w)
            out = []
            for t in sorted(items):
                change = np.diff(np.concatenate([[0], hit[w.first[t] : w.first[t + 1]].astype(np.int8), [0]]))
                out.append((t, np.flatnonzero(change == 1), np.flatnonzero(change == -1), sorted(items[t])))
            if out:
                of, *lists = zip(*out, strict=True)
                mine = batch.select(list(rows.KEYS)).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*mine.columns, *(pa.array(x, k) for x, k in zip(lists, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True))], names=[*rows.KEYS, "starts", "ends", "items"])

    found = rows.written(docs.mapInArrow(run, "row_key long, row_check long, starts array<int>, ends array<int>, items array<string>"), name)
    held.destroy()
    return found


def _merged(docs: DataFrame, text_col: str, groups: Iterator[list[ItemAutomaton]]) -> tuple[DataFrame, str]:
    """docs with a column of the hits of all groups, one pass for each, and that column's name."""
    keyed, names = rows.with_keys(docs, text_col, text_col)
    texts = docs.select(*(c.alias(k) for c, k in zip(rows.key_columns(text_col, text_col), rows.KEYS, strict=True)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = [_hits_by_document(texts, g, f"hits-{k}") for k, g in enumerate(groups)]
    every = reduce(DataFrame.unionByName, found).groupBy(*(F.col(k).alias(n) for k, n in zip(rows.KEYS, names, strict=True)))
    hits = every.agg(F.struct(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")), F.flatten(F.collect_set("items")).alias("items")).alias(f"hits_{names[0]}"))
    return keyed.join(hits, names, "left").drop(*names), f"hits_{names[0]}"


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 250_000, resident_words: int = 1_000_000, clean: bool = True
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and (if clean) cleaned, the text without its hits."""
    spark = docs.sparkSession
    added = [f for f in _ADDED.fields if clean or f.name != "cleaned"]
    names = [f.name for f in added]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *added])
    automata = _automata(benchmark, item_col, item_text_col, window, block_words)
    in_one = (automata.agg(F.sum("words")).first()[0] or 0) <= resident_words or automata.count() == 1
    merged = None
    if in_one:
        held = spark.sparkContext.broadcast(next(_groups(automata, resident_words), []))
    else:
        docs, merged = _merged(docs, text_col, _groups(automata, resident_words))
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(added)]]

    def hits(batch: pa.RecordBatch, i: int, w: tx.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        if merged is None:
            return _hits(held.value, w)
        hit, items = np.zeros(len(w), dtype=bool), {}
        for t, x in enumerate(batch.column(merged).slice(i, len(w.counts)).to_pylist()):
            for s, e in zip(x["starts"], x["ends"], strict=True) if x else ():
                hit[w.first[t] + s : w.first[t] + e] = True
            if x:
                items[t] = set(x["items"])
        return hit, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            data, bounds = tx.flat(column)
            out = []
            for i, j in tx.chunked(bounds):
                part = data[bounds[i] : bounds[j]]
                w = tx.Words(part, bounds[i : j + 1] - bounds[i], tx.ALNUM)
                out += _judged(part, w, *hits(batch, i, w), clean)
            values = [list(v) for v in zip(*out, strict=True)] or [[] for _ in _ADDED]
            more = [pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)]
            if clean:
                more[5] = pa.array([c if c is not None else t for c, t in zip(values[5], column.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more[: len(names)]], names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, max_fraction: float = 0.5, max_hit: int | None = None) -> DataFrame:
    """docs without hit spans; a document with over `max_fraction` of its words (or over `max_hit`) hit is dropped.

    Returns the columns of docs. Documents without a hit keep their text unchanged.
    """
    d = scan(docs, benchmark, text_col, window=window)
    keep = F.col("n_hit") <= F.lit(max_fraction) * F.col("n_words")
    if max_hit is not None:
        keep &= F.col("n_hit") <= max_hit
    d = d.filter(keep)
    return d.select(*(F.col("cleaned").alias(c) if c == text_col else F.col(c) for c in docs.columns))
