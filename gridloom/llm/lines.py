"""Line dedup: later copies of repeated runs of lines are deleted.

The texts are sequences of line IDs (lines without a word are left out and stay). A suffix array
over them is built by prefix doubling: a round ranks every run of 2**k lines that occurs twice
from the ranks of its halves, by one sort of the distinct pairs over the cluster. Lines and runs
that occur once drop out, so a round only sorts what is still repeated.

Two suffixes share their first n lines if and only if the ranks of the two (overlapping) runs of
2**k lines that make up those n are equal, k = floor(log2 n). For every suffix and length n looked
at, the interval of the suffix array with longest common prefix n or more is therefore one key; but
for its first suffix, in the order of documents and lines, the interval's suffixes are later copies.

The lengths looked at are those of the shortest runs of `min_chars` characters from each line on
and up to each line. Every line x of a longer copied run, from s to f, is in one of these within
that run: in the shortest from x on if x to f has the characters, in the shortest up to x if s to x
has them, and in the shortest from s on otherwise. So the union of the later copies is every line
of every later copy of a repeated run, maximal ones included, of `min_chars` or more, its short
last lines too; and a document has at most two runs for each of its lines.

Defined results: a null text is an empty one; an empty text stays empty; rows with
equal id and text are copies, of which the first stays as far as it is no copy itself (as equal
rows can't be told apart, they get one result: what both lose); ids are compared as they sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx

_LINE = "row_key long, row_check long, place int, a long, b long, least int, longest int"


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row_key, row_check, place, a, b, least, longest) for each line with a word; a and b are the line's ID.

    least and longest: number of lines of the shortest and the longest run from here on that is looked at; null if the text ends
    before min_chars. The shortest is the first with min_chars characters. Those up to a later line that begin
    here go on while what follows the first line has under min_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches):
            w = worded_lines(data, bounds)
            if not len(w.starts):
                continue
            upto = np.concatenate([[0], np.cumsum(w.chars)])
            place = np.arange(len(w.starts))
            end = w.first[w.of + 1]
            far = lambda first: np.searchsorted(upto, upto[first] + min_chars)  # noqa: E731  one behind the last line of the run from `first` on
            least = far(place)
            longest = np.maximum(least, np.minimum(far(place + 1) - 1, end)) - place
            fits = least <= end
            spans = (pa.array(x.astype(np.int32), mask=~fits) for x in (least - place, longest))
            ids = (tx.span_hashes(data, w.starts, w.ends, t).view(np.int64) for t in (tx.BYTES, tx.SECOND))
            mine = batch.select(["doc_id", *rows.KEYS]).take(pa.array(w.of))
            yield pa.RecordBatch.from_arrays([*mine.columns, pa.array((place - w.first[w.of]).astype(np.int32)), *map(pa.array, ids), *spans], names=["doc_id", *rows.KEYS, "place", "a", "b", "least", "longest"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_LINE}")


class WordedLines(NamedTuple):
    """Byte spans, characters and texts of the lines with a word; text d has lines first[d]..first[d+1]-1 of them."""

    starts: np.ndarray
    ends: np.ndarray
    chars: np.ndarray
    of: np.ndarray
    first: np.ndarray


def worded_lines(data: np.ndarray, bounds: np.ndarray) -> WordedLines:
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], bounds[np.searchsorted(bounds, starts, side="right")])
    word, char = (np.concatenate([[0], np.cumsum(x)]) for x in (tx.NOT_BLANK[data], (data & 0xC0) != 0x80))
    kept = word[ends] > word[starts]
    starts, ends = starts[kept], ends[kept]
    of = np.searchsorted(bounds, starts, side="right") - 1
    return WordedLines(starts, ends, char[ends] - char[starts], of, np.searchsorted(of, np.arange(len(bounds))))


def _ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The values of `by` that occur in two rows or more, with their rank in sorted order (increasing, with gaps)."""
    twice = df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    return rows.written(twice.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def later_copies(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(row_key, row_check, places): places of the lines to delete, among the lines with a word."""
    at = ["doc_id", *rows.KEYS, "place"]
    line = rows.written(_line_rows(docs, min_chars), "lines")
    span = ["least", "longest"]
    level = rows.written(line.join(_ranked(line, ["a", "b"], "ranks-0"), ["a", "b"]).select(*at, *span, "rank").dropDuplicates([*rows.KEYS, "place"]), "level-0")
    starts = []
    length, most = 1, level.agg(F.max("longest")).first()[0] or 0
    while length <= most:
        mine = level.filter((F.col("longest") >= length) & (F.col("least") < 2 * length))
        mine = mine.select(*at, "rank", F.explode(F.sequence(F.greatest("least", F.lit(length)), F.least("longest", F.lit(2 * length - 1)))).alias("need"))
        other = level.select(*(F.col(c).alias(f"{c}_2") for c in (*at, "rank")))
        there = (level["row_key"] == other["row_key_2"]) & (level["row_check"] == other["row_check_2"])
        if length == 1:
            starts.append(mine.select(*at, "need", "rank", F.col("rank").alias("rank_2")))
        else:
            starts.append(mine.join(other, there & (mine["place"] + mine["need"] - length == other["place_2"])).select(*at, "need", "rank", "rank_2"))
        if 2 * length > most:
            break
        behind = Window.partitionBy(*rows.KEYS).orderBy("place").rangeBetween(length, length)
        pairs = level.select(*at, *span, F.col("rank").alias("first"), F.max("rank").over(behind).alias("second")).filter("second is not null")
        pairs = rows.written(pairs, "pairs")
        length *= 2
        ranks = _ranked(pairs, ["first", "second"], f"ranks-{length}")
        level = rows.written(pairs.join(ranks, ["first", "second"]).select(*at, *span, "rank"), f"level-{length}")
        if level.isEmpty():
            break
    if not starts:
        return docs.select(*rows.KEYS, F.array().cast("array<int>").alias("places")).limit(0)
    suffixes = starts[0]
    for more in starts[1:]:
        suffixes = suffixes.unionByName(more)
    interval = ["need", "rank", "rank_2"]
    first = suffixes.groupBy(*interval).agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join_hot(suffixes, first, interval).filter(~F.struct(*at).eqNullSafe(F.col("first")))
    places = later.select(*rows.KEYS, F.explode(F.sequence("place", F.col("place") + F.col("need") - 1)).alias("place"))
    return places.groupBy(*rows.KEYS).agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """doc_id, row_key, row_check, n_lines (with a word), n_removed and kept_text for each row of docs."""
    d = rows.keyed(docs, id_col, text_col)
    d = rows.with_info(d, later_copies(d, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in rows.text_chunks(batches):
            w, places, kept, lost = worded_lines(data, bounds), batch.column("places"), [], []
            for t, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                gone = np.sort(places[t].values.to_numpy()) + w.first[t] if places[t].is_valid else w.first[:0]
                lost.append(len(gone))
                kept.append(_without(data[i:j], w.starts[gone] - i, w.ends[gone] - i) if len(gone) else data[i:j].tobytes())
            columns = [batch.column(c) for c in ("doc_id", *rows.KEYS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(w.first)), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", *rows.KEYS, "n_lines", "n_removed", "kept_text"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, row_key long, row_check long, n_lines long, n_removed long, kept_text string")


def _without(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without these lines, each with the line break behind it, or the one before it if nothing follows that stays."""
    keep = ~tx.covered(starts, np.minimum(ends + 1, len(text)) - starts, len(text))
    if len(ends) and ends[-1] == len(text) and keep.any():
        keep[np.flatnonzero(keep)[-1]] = False  # the break behind the last line that stays
    return text[keep].tobytes()
