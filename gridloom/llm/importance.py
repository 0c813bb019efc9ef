"""Target-distribution importance resampling: documents drawn by how much more likely their n-grams are in a target.

Words come from Arrow kernels over a batch's texts (ascii_lower, split_pattern_regex, list_flatten,
dictionary_encode); the dictionary's indices, shifted by one word for each further word of an n-gram, form n-grams, of which
only the distinct ones of the batch are hashed. A feature's bucket is its CRC modulo `buckets`. Each task adds
up its buckets, so a pass over a table shuffles at most `buckets` rows for each task, and the gains, one number for each bucket, are
all that the driver and the tasks hold. In the second pass gains are taken by bucket and summed over the segments of documents.

The draw keeps the documents with the highest sums of weight and Gumbel noise, which is a draw without replacement by
exp(weight / 1000). The noise is a hash of the id, so it's the same in any partitioning. Places come from a range
sort of narrow rows by score, id and their place in the written table, so many equal rows are dealt to many tasks.

Defined results: a null text has no words; rows with equal id and text have equal weights and scores, and are drawn one by
one; a null id is hashed like an empty one and comes last among ties; documents with fewer than `least_words` words have a weight and a score
but no rank; an empty table on either side counts no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx
from gridloom.operators import sampling

#: What stands between words, once A-Z are a-z: all of ASCII but letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CHUNK = 2 << 20


class Features:
    """Bucket and text of each n-gram of 1 to `grams` words of some texts, and the texts' numbers of words."""

    def __init__(self, texts: pa.Array, grams: int, buckets: int) -> None:
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_BETWEEN)
        coded = pc.list_flatten(lists).dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        real = np.array([bool(w) for w in words], dtype=bool)[index]  # a text that begins or ends between words has an empty one there
        index, of = index[real], of[real]
        self.words = np.bincount(of, minlength=len(texts))
        crc, gram = np.array([zlib.crc32(w) for w in words], dtype=np.int64), index
        found, owners = [crc[gram] % buckets], [of]
        for n in range(2, grams + 1):
            start = np.flatnonzero(of[: 1 - n] == of[n - 1 :]) if len(of) >= n else of[:0]  # words whose n-gram is within their text
            pair, code = np.unique(gram[start] * len(words) + index[start + n - 1], return_inverse=True)
            crc = np.array([zlib.crc32(b" " + words[p % len(words)], int(crc[p // len(words)])) for p in pair.tolist()], dtype=np.int64)
            gram = np.full(len(of), -1, dtype=np.int64)
            gram[start] = code
            found.append(crc[code] % buckets)
            owners.append(of[start])
        self.bucket, self.of = np.concatenate(found), np.concatenate(owners)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about `_CHUNK` bytes of text, or of one longer text; nulls are empty."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    batch = batch.set_column(batch.schema.get_field_index("text"), "text", texts)
    _, bounds = tx.flat(texts)
    for i, j in tx.chunked(bounds, _CHUNK):
        yield batch.slice(i, j - i)


def _texts(docs: DataFrame, *columns: str, text_col: str) -> DataFrame:
    return docs.select(*columns, F.col(text_col).cast("string").alias("text"))


def bucket_counts(docs: DataFrame, text_col: str = "text", grams: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of the table's texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for some in _chunks(batch):
                n += np.bincount(Features(some.column("text"), grams, buckets).bucket, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in _texts(docs, text_col=text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of the target's smoothed share of each bucket over the source's."""
    s, t, many = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + many) / ((s + 1) * (t.sum() + many)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of its features, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch):
                f = Features(some.column("text"), grams, len(gain))
                order = np.argsort(f.of, kind="stable")
                first = np.searchsorted(f.of[order], np.arange(some.num_rows + 1))
                columns = [f.words.astype(np.int64), np.diff(first), tx.per_text(gain[f.bucket[order]], first)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    d = _texts(docs, F.col(id_col).alias("doc_id"), text_col=text_col)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for each row of docs; rank is null for those not drawn.

    Of the documents with `least_words` words or more, `percent` in a hundred (rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, target_col, grams, buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = weighed(docs, gain, id_col, text_col, grams).withColumn("score", F.col("weight") + noise)
    scored = rows.written(scored.withColumn("at", F.monotonically_increasing_id()), "scored")
    wanted = scored.filter(F.col("n_words") >= least_words)
    many = percent * wanted.count() // 100
    placed = sampling.numbered(wanted, "place", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at"))
    drawn = placed.withColumn("rank", F.when(F.col("place") < many, F.col("place") + 1)).drop("place", "at")
    rest = scored.filter(F.col("n_words") < least_words).drop("at").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)
