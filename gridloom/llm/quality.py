"""Quality rules: word, line and symbol counts, and repetition found by a suffix array per text.

For every text a suffix array over its words is built by prefix doubling (all texts of a chunk
in one numpy sort per round, and only suffixes that still tie go on). The longest common
prefixes of neighbours give each word's longest repeat; their union gives the covered words.

Defined results: a null or blank text has no words and fails the base rule; repeated rows are
judged row by row; other columns are untouched. Nothing is shuffled, so no key can be hot.
A task holds one chunk of `text.CHUNK` bytes, or one longer text, at a time. Words and lines are told apart by
a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import text as tx

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def longest_repeats(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each item, how many items from it on also stand elsewhere in its text (0: under two).

    items: equal items are equal 64-bit values; first: the bounds of the texts.
    """
    n = len(items)
    longest = np.zeros(n, dtype=np.int64)
    if not n:
        return longest
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    key = tx.mix(items ^ tx.mix(owner + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    slot = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # where the group of each sorted suffix begins
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slot
    levels, have = [rank.copy()], 1
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        then = at + have
        inside = then < end[at]
        second = np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        pair = slot[slots] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        pair, at = pair[by], at[by]
        order[slots] = at
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        slot[slots] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank[at] = slot[slots]
        have *= 2
        levels.append(rank.copy())
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = slots[tied]
    # Neighbours in the suffix array that share two items at least, and how many they share.
    base = levels[min(1, len(levels) - 1)]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(base[a] == base[b])
    a, b = a[near], b[near]
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        same = (i < end[a]) & (j < end[b])
        same[same] = levels[k][i[same]] == levels[k][j[same]]
        shared[same] += 1 << k
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text bounds of the lines between newlines."""
    breaks = np.flatnonzero(data == 0x0A)
    many = np.diff(np.searchsorted(breaks, bounds)) + 1
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([bounds[1:], breaks]))
    return starts, ends, np.concatenate([[0], np.cumsum(many)])


def _chunk_counts(data: np.ndarray, bounds: np.ndarray, span: int) -> dict[str, np.ndarray]:
    w = tx.Words(data, bounds, tx.NOT_BLANK)
    longest = longest_repeats(w.hashes(), w.first)
    three, spans = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= span)
    starts, ends, line_first = _lines(data, bounds)
    wordy = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    of = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(line_first))[wordy]
    key = tx.mix(tx.span_hashes(data, starts[wordy], ends[wordy]) ^ tx.mix(of + np.uint64(1)))
    _, kept = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[kept] = False
    char = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(tx.NOT_BLANK[data] & ((data & 0xC0) != 0x80), out=char[1:])
    symbol = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[data], out=symbol[1:])
    most = np.zeros(len(bounds) - 1, dtype=np.int64)
    np.maximum.at(most, w.text_of(), np.where(longest >= 2, longest, 0))
    return {
        "n_words": w.counts,
        "word_chars": np.diff(char[bounds]),
        "n_symbols": np.diff(symbol[bounds]),
        "n_dup_lines": np.bincount(of[again].astype(np.int64), minlength=len(bounds) - 1),
        "n_repeat_words": tx.per_text(tx.covered(three, 3, len(w)), w.first),
        "covered_words": tx.per_text(tx.covered(spans, longest[spans], len(w)), w.first),
        "longest_repeat": most,
    }


def repetition_counts(docs: DataFrame, text_col: str = "text", span: int = 10) -> DataFrame:
    """docs with the counts in `_COUNTS` added (replacing columns of those names).

    covered_words: words in maximal repeated substrings of `span` words or more, the first copy
    included; longest_repeat: words of the longest substring that stands twice, overlaps allowed.
    """
    docs = docs.drop(*_COUNTS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tx.flat(batch.column(text_col))
            parts = [_chunk_counts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], span) for i, j in tx.chunked(bounds)]
            more = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *_COUNTS])

    return docs.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, text_col: str = "text", span: int = 10, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50) -> DataFrame:
    """docs with the counts, base_failed and kept.

    base_failed: under `min_words` words, or over half of the words in repeated three-word windows.
    kept: not base_failed, at most `max_covered` of the words in repeated substrings of `span`
    words or more, and no repeated substring of over `max_longest` words.
    """
    d = repetition_counts(docs, text_col, span).drop("base_failed", "kept")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (F.col("covered_words") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return d.withColumn("base_failed", base).withColumn("kept", ~base & method)
