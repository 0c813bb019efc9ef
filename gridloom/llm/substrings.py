"""Substring dedup by level-wise doubling: words in a window that also starts elsewhere are removed.

Level one asks which runs of `start_words` words are repeated; only windows whose run is are
taken to twice that length, and so on up to `window` words, or until no candidate survives.

Which run stands for a window must not depend on where the window is: it is the one of least
hash among the window's runs (so one run in about (window - run) / 2 is shuffled, not each). Equal
windows have equal runs of least hash, so a window whose run is not repeated is not either. The
last level compares the windows themselves, by 64-bit hash.

Every run is first counted within its document, so a passage that repeats in one text is one
row, and counts are added before and after the shuffle. What a document gets back are the
places of runs that survive; joins that send them back may split hot hashes (AQE skew join).
Texts are shuffled once, packed; a lost executor's share is computed anew from the input.

Defined results: a null text is an empty one; rows with equal id and text are copies of each
other (and so are removed like copies; their places are kept once); rows of one id with different texts are different
documents; a text of fewer words than the window keeps all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx


def levels(window: int, start_words: int) -> list[int]:
    """start_words, twice that, ... and the window itself."""
    out = [min(start_words, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def least_runs(hashes: np.ndarray, room: np.ndarray, run: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run, of the least run of each window (by its start), and whether a window starts there.

    All three have one entry for each item; entries without a run or window are not to be used.
    """
    n = len(hashes)
    runs = np.zeros(n, dtype=np.uint64)
    h = tx.run_hashes(hashes, run, run)
    runs[: len(h)] = h
    least = np.zeros(n, dtype=np.uint64)
    m = tx.sliding(h, window - run + 1, np.minimum)
    least[: len(m)] = m
    return runs, least, room >= window


def selected(runs: np.ndarray, least: np.ndarray, full: np.ndarray, width: int) -> np.ndarray:
    """Positions of the runs that are the least of some window (`width`: runs in a window)."""
    best = np.zeros(len(runs) + width - 1, dtype=np.uint64)
    best[width - 1 :] = np.where(full, least, 0)
    return np.flatnonzero((runs == tx.sliding(best, width, np.maximum)) & (runs != 0))


def _of_text(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The same hashes, told apart by text."""
    return hashes ^ tx.mix(text_of.astype(np.uint64) + np.uint64(1))


def _surviving(w: tx.Words, hashes: np.ndarray, done: list[tuple[int, np.ndarray, np.ndarray]], window: int) -> np.ndarray:
    """Whether each word starts a window that survived the levels in `done`.

    done: run length, places in the text where a repeated run first stands there, and their texts.
    """
    room, text_of = w.room(), w.text_of()
    alive = room >= window
    for run, places, of in done:
        runs, least, _ = least_runs(hashes, room, run, window)
        alive &= np.isin(_of_text(least, text_of), _of_text(runs[w.first[of] + places], of))
    return alive


def _mapped(docs: DataFrame, fn: Callable, schema: str, found: list[int]) -> DataFrame:
    """fn(words, ids of the texts, keys, surviving keys by level) for each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches):
            w = tx.Words(data, bounds, tx.NOT_BLANK)
            done = []
            for level in found:
                kept = batch.column(f"level_{level}")
                done.append((level, kept.flatten().to_numpy(zero_copy_only=False), _owners(kept)))
            out = fn(batch, w, done)
            if out is not None and out.num_rows:
                yield out

    return docs.mapInArrow(run, schema)


def _owners(lists: pa.ListArray) -> np.ndarray:
    """Which list each value of lists.flatten() is in."""
    lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(lists)), lengths)


def _level_rows(docs: DataFrame, run: int, window: int, found: list[int]) -> DataFrame:
    """(row_key, row_check, run_hash, n, place): each document's runs of this level that stand for a surviving window.

    Equal runs of a document are one row: how many, and the place of the first.
    """

    def rows_of(batch: pa.RecordBatch, w: tx.Words, done: list) -> pa.RecordBatch | None:
        h, text_of = w.hashes(), w.text_of()
        runs, least, full = least_runs(h, w.room(), run, window)
        full = _surviving(w, h, done, window) if done else full
        at = selected(runs, least, full, window - run + 1)
        if not len(at):
            return None
        _, first, n = np.unique(_of_text(runs[at], text_of[at]), return_index=True, return_counts=True)
        order = np.argsort(first)
        at, n = at[first[order]], n[order]
        mine = batch.select(list(rows.KEYS)).take(pa.array(text_of[at]))
        places = (at - w.first[text_of[at]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*mine.columns, pa.array(runs[at].view(np.int64)), pa.array(n.astype(np.int32)), pa.array(places)], names=[*rows.KEYS, "run_hash", "n", "place"])

    return _mapped(docs, rows_of, "row_key long, row_check long, run_hash long, n int, place int", found)


def repeated_runs(docs: DataFrame, window: int = 35, start_words: int = 18) -> DataFrame:
    """docs (from rows.keyed, packed) with column `level_<window>`: places of its windows that also start elsewhere.

    Of equal windows of a document the first place is listed.
    """
    steps, found = levels(window, start_words), []
    texts = rows.packed(docs)
    out = docs
    for level in steps:
        runs = _level_rows(out, level, window, found)
        twice = runs.groupBy("run_hash").agg(F.sum("n").alias("n")).filter("n > 1").select("run_hash")
        kept = rows.join_hot(runs, twice, ["run_hash"], "left_semi").groupBy(*rows.KEYS).agg(F.collect_set("place").alias(f"level_{level}"))
        # Only documents with survivors go on; at the end each gets its last survivors, or none.
        last = level == steps[-1]
        out = rows.with_info(texts if last or not found else out, kept, "left" if last else "inner")
        found.append(level)
    return out


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, start_words: int = 18, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if with_text) kept_text for each row of docs."""
    d = repeated_runs(rows.keyed(docs, id_col, text_col), window, start_words)

    def rows_of(batch: pa.RecordBatch, w: tx.Words, done: list) -> pa.RecordBatch:
        gone = np.zeros(len(w), dtype=bool)
        if len(done[0][1]):
            starts = np.flatnonzero(_surviving(w, w.hashes(), done, window))
            gone = tx.covered(starts, window, len(w))
        lost = tx.per_text(gone, w.first)
        digests, texts = [], []
        keep = ~gone
        for t, bad in enumerate(lost.tolist()):
            words = w.data[w.bounds[t] : w.bounds[t + 1]].tobytes().split()
            kept = b" ".join(compress(words, keep[w.first[t] : w.first[t + 1]].tolist()) if bad else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace") if with_text else None)
        columns = [batch.column("doc_id"), pa.array(w.counts), pa.array(lost), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    kind = dict(d.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _mapped(d, rows_of, schema, [window])
