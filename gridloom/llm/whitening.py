"""Embedding whitening with Spark MLlib's BlockMatrix.

Entries become whole numbers (floor of `scale` times the entry). Each distinct vector counts once in the fit: mean and covariance
are of these. Their rows, centred, are indexed into distributed blocks; transposed and multiplied with themselves the blocks give the
scatter matrix, in partial products that are added up by pairs of column blocks, so no task gets more than its share of the rows. Its
eigenvectors are found on the driver (a matrix of the dimension's square, which does not grow with the rows). The centred rows of the whole
table times the whitening matrix (eigenvectors over the roots of their eigenvalues) are one more product of blocks.

Rows get dense numbers when they are written, so blocks are full, and what is projected returns to its row by a
number that no other row has: many equal vectors do not meet in a task. A BlockMatrix has at most `panel` rows, larger tables are
several panels, whose scatter matrices add up.

Defined results: rows whose vector is null, empty, or holds a null or an entry that is not finite are left out, and so are those of another
length than most vectors have (of equally frequent lengths, the largest); repeated rows are projected each, and counted
once; components without variance (an eigenvalue of at most 1e-12 of the trace, as where all vectors are equal) have whitened null and
explained 0; there are as many components as asked for, or as the vectors have entries; a deviation too large for a long is null; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.operators import sampling


class Fit(NamedTuple):
    """What the distinct vectors say: how many, the sums of their entries, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; zero for those without variance."""
        return np.where(self.some, self.vectors / np.sqrt(np.where(self.some, self.values, 1.0)), 0.0)

    @property
    def some(self) -> np.ndarray:
        """The components that have variance."""
        return self.values > 1e-12 * self.trace


def whole_numbers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x (array of longs) and at (a number from 0 on) for each row with a sound vector, as a written table."""
    c = F.col("c")
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    d = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter(sound)
    sizes = d.groupBy(F.size("c").alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    d = d.filter(F.size("c") == (sizes["size"] if sizes else 0)).select("vec_id", F.transform("c", lambda v: F.floor(scale * v).cast("long")).alias("x"))
    return sampling.indexed(d, "at")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors, and the sums of their entries; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + _matrix(batch.column("x"), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array(np.concatenate([[n], total]))], names=["dim", "s"])

    done = fit.select("x").mapInArrow(run, "dim long, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    sums = {r["dim"]: int(r["s"]) for r in done}
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(width)]


class _Blocked(NamedTuple):
    """How rows are dealt into blocks."""

    last: int
    block_rows: int
    block_columns: int
    panel: int


def _blocks(d: DataFrame, mean: np.ndarray, first: int, dealt: _Blocked) -> BlockMatrix:
    """Rows `at` and x of a panel (from number `first` on), centred, as distributed blocks. Numbers without a row are rows of zeros, or in no block."""
    centred = F.zip_with("x", F.lit(mean), lambda x, m: x - m)
    vectors = d.select((F.col("at") - first).alias("index"), array_to_vector(centred).alias("vector"))
    # A product reads its blocks several times; those that are lost are made again from the written rows.
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), min(dealt.panel, dealt.last + 1 - first), len(mean))
    return matrix.toBlockMatrix(dealt.block_rows, dealt.block_columns).persist(StorageLevel.MEMORY_AND_DISK)


def _dropped(blocks: BlockMatrix) -> None:
    """Give back what `_blocks` keeps."""
    blocks._java_matrix_wrapper.call("blocks").unpersist(False)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left times right; the dimension they share is cut into `splits`, whose partial products are added up."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _panels(d: DataFrame, last: int, panel: int) -> Iterator[tuple[int, DataFrame]]:
    for first in range(0, last + 1, panel):
        yield first, d if last < panel else d.filter((F.col("at") >= first) & (F.col("at") < first + panel))


def fitted(fit: DataFrame, width: int, components: int, dealt: _Blocked) -> Fit:
    """fit: at and x of each distinct vector."""
    n, sums = _sums(fit, width)
    mean = np.array([s / n for s in sums])
    scatter = np.zeros((width, width))
    for first, d in _panels(fit, dealt.last, dealt.panel):
        a = _blocks(d, mean, first, dealt)
        scatter += _product(a.transpose(), a, max(1, a._java_matrix_wrapper.call("blocks").getNumPartitions())).toLocalMatrix().toArray()
        _dropped(a)
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    best = np.argsort(-values, kind="stable")[:components]
    return Fit(n, sums, np.maximum(values[best], 0.0), vectors[:, best], float(np.trace(covariance)))


def projected(d: DataFrame, fit: Fit, dealt: _Blocked) -> DataFrame:
    """at, whitened (array of doubles) for each row of d (at, x), as written tables of a panel each."""
    width, many = fit.vectors.shape
    step = dealt.block_columns
    parts = [((k, 0), Matrices.dense(len(m), many, m.ravel(order="F"))) for k, m in enumerate(fit.matrix[i : i + step] for i in range(0, width, step))]
    out = []
    for first, some in _panels(d, dealt.last, dealt.panel):
        by = BlockMatrix(d.sparkSession.sparkContext.parallelize(parts, 1), step, many, width, many)
        a = _blocks(some, fit.mean, first, dealt)
        found = callMLlibFunc("getIndexedRows", _product(a, by).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        out.append(rows.written(found.select((F.col("index") + first).alias("at"), vector_to_array("vector").alias("whitened")), "projected"))
        _dropped(a)
    return reduce(DataFrame.unionByName, out)


def _deviations(d: DataFrame, fit: Fit) -> DataFrame:
    """vec_id, at and deviation: the sum of (n x - sum)**2 over the dimensions, exact."""
    sums, width = np.array([s % (1 << 64) for s in fit.sums], dtype=np.uint64).view(np.int64), len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            about = ((x * float(fit.n) - np.array(fit.sums, dtype=np.float64)) ** 2).sum(axis=1)
            exact = ((x * np.int64(fit.n) - sums) ** 2).sum(axis=1)  # modulo 2**64, so exact wherever a long holds it
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("at"), pa.array(exact, mask=about > 9.2e18)], names=["vec_id", "at", "deviation"])

    return d.mapInArrow(run, f"vec_id {dict(d.dtypes)['vec_id']}, at long, deviation long")


def _identity_error(known: DataFrame, some: list[int]) -> float:
    """The largest absolute entry of the covariance of `whitened`, of the components with variance, minus the identity."""
    w: dict[int, Column] = {k: F.get("whitened", F.lit(k)) for k in some}
    pairs = [(i, j) for i in some for j in some if i <= j]
    if not pairs:
        return 0.0
    got = known.agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, block_rows: int = 1024, block_columns: int = 1024, panel: int = 1 << 30) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each sound row and component."""
    d = whole_numbers(table, id_col, vector_col, scale)
    last = d.agg(F.max("at"), F.max(F.size("x"))).first()
    schema = f"vec_id {dict(d.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if last[0] is None:
        return d.sparkSession.createDataFrame([], schema)
    dealt, width = _Blocked(last[0], block_rows, min(block_columns, last[1]), panel), last[1]
    distinct = rows.written(d.groupBy("x").agg(F.min("at").alias("at")), "distinct")
    fit = fitted(distinct, width, min(components, width), dealt)
    placed = projected(d.select("at", "x"), fit, dealt)
    error = _identity_error(placed.join(distinct.select("at"), "at", "left_semi"), np.flatnonzero(fit.some).tolist())
    share = np.where(fit.some, fit.values / (fit.trace or 1.0), 0.0).tolist()
    value = F.when(F.get(F.lit(fit.some.tolist()), F.col("k")), F.col("w"))
    out = _deviations(d, fit).join(placed, "at").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", value.alias("whitened"), F.get(F.lit(share), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
