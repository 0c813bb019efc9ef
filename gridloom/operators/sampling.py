"""Random choices that depend on the rows only, not on partitions: orders and draws by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import tables


def hash_order(seed: str, *keys: Column) -> Column:
    """A value to order by, as good as a shuffle with this seed."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys)))


def uniform(seed: str, low: float, high: float, *keys: Column) -> Column:
    """A draw from [low, high) for these keys."""
    unit = F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.lit(low) + unit * F.lit(high - low)


def split(rows: DataFrame, by: str, key: str, fraction: float = 0.2, seed: str = "42", base: str | None = None) -> DataFrame:
    """rows with split: `val` for exactly floor(n * fraction) rows of each class, the first by hash, else `train`.

    base: a column whose equal values stay together (variants of one image); the counts are of its values then.
    Instead of ranking a whole class in one task, hashes are counted by their first three digits, and only
    the rows of the one count in which the border falls are ranked.
    """
    unit = base or key
    d = rows.select(by, unit).distinct() if base else rows
    d = d.withColumn("__hash", hash_order(seed, F.col(by), F.col(unit))).withColumn("__bin", F.substring("__hash", 1, 3))
    bins = d.groupBy(by, "__bin").agg(F.count("*").alias("__n"))  # at most 4096 rows a class
    w = Window.partitionBy(by)
    bins = bins.withColumns({"__upto": F.sum("__n").over(w.orderBy("__bin")), "__want": F.floor(F.sum("__n").over(w) * F.lit(fraction))})
    bins = bins.select(F.col(by).alias("__by"), F.col("__bin").alias("__b"), (F.col("__upto") <= F.col("__want")).alias("__all"), (F.col("__upto") - F.col("__n") >= F.col("__want")).alias("__none"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__some"))
    d = d.join(bins, d[by].eqNullSafe(bins["__by"]) & (d["__bin"] == bins["__b"]))
    rank = F.row_number().over(Window.partitionBy(by, "__bin", "__inside").orderBy("__hash", unit))
    d = d.withColumn("__inside", ~F.col("__all") & ~F.col("__none"))
    inside = d.filter("__inside").withColumn("split", F.when(rank <= F.col("__some"), "val").otherwise("train"))
    outside = d.filter("not __inside").withColumn("split", F.when(F.col("__all"), "val").otherwise("train"))
    out = outside.unionByName(inside)
    if not base:
        return out.select(*rows.columns, "split")
    named = out.select(F.col(by).alias("__k1"), F.col(unit).alias("__k2"), "split")
    return rows.join(named, rows[by].eqNullSafe(named["__k1"]) & rows[unit].eqNullSafe(named["__k2"])).select(*rows.columns, "split")


def first_per_group(rows: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each group; every task keeps its own first ones before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__rank") <= most).drop("__rank")


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once, with a number from 0 on without gaps, in the order of partitions and of rows in them.

    A row's partition and place in it are written with the row, so what is counted is what is numbered, whatever a later
    plan of the same rows would look like; numbers then come from one row of sums for each partition. Fails if a partition's
    places are not what was counted.
    """
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    d = tables.written(rows.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    sizes = d.groupBy(F.shiftright("__place", 33).alias("__p")).agg(F.count("*").alias("__n"), F.max(place).alias("__last"))
    sound = F.when(F.col("__last") + 1 == F.col("__n"), F.col("__n")).otherwise(F.raise_error(F.lit("rows were lost while they were numbered")).cast("long"))
    sizes = sizes.select("__p", sound.alias("__n"))  # a row for each partition
    upto = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("__p", (upto - F.col("__n")).alias("__before"))
    return d.join(F.broadcast(sizes), F.shiftright("__place", 33) == F.col("__p")).withColumn(name, F.col("__before") + place).select(*rows.columns, name)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their 0-based place in this order, from a range sort that is written once.

    Rows that are equal in all of `order` are sorted by one task: end it with a column that tells them apart if there may be many.
    """
    return indexed(rows.repartitionByRange(*order).sortWithinPartitions(*order), name)


def batches(rows: DataFrame, key: str, size: int = 32, seed: str = "epoch") -> DataFrame:
    """rows with `batch`: shuffled by hash and cut into batches of exactly `size` rows, but for the last.

    Hashes are counted by their first four digits, so rows are only ranked among those that share these.
    """
    d = rows.withColumn("__hash", hash_order(seed, F.col(key))).withColumn("__bin", F.substring("__hash", 1, 4))
    bins = d.groupBy("__bin").agg(F.count("*").alias("__n"))  # at most 65,536 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(F.col("__bin").alias("__b"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bin").orderBy("__hash", key)) - 1
    d = d.withColumn("__within", within)
    place = F.col("__before") + F.col("__within")
    return d.join(bins, d["__bin"] == bins["__b"]).withColumn("batch", F.floor(place / size)).select(*rows.columns, "batch")


def epoch_batches(rows: DataFrame, key: str, epochs: int, size: int = 32, seed: str = "epoch") -> DataFrame:
    """rows once for each epoch (from 1), with `epoch` and `batch`; each epoch, whose number is in the seed, deals them in another order."""
    out = None
    for epoch in range(1, epochs + 1):
        one = batches(rows, key, size, f"{seed}-{epoch}").withColumn("epoch", F.lit(epoch))
        out = one if out is None else out.unionByName(one)
    return out


def batch_scan(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, size: int = 32) -> DataFrame:
    """fn over whole batches: each batch (columns epoch, batch) reaches it as one Arrow batch, those of a task in order.

    The task that reads a batch's rows puts them together, so a batch may be as large as a task's memory; all its rows are dealt to
    one partition. fn is called once for each task, like that of mapInArrow.
    """

    def whole(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for some in arrow:
            epoch, batch = (some.column(c).to_numpy() for c in ("epoch", "batch"))
            cuts = [0, *(np.flatnonzero((epoch[1:] != epoch[:-1]) | (batch[1:] != batch[:-1])) + 1).tolist(), len(epoch)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and (epoch[i], batch[i]) != now:
                    yield _one(held)
                    held = []
                now = (epoch[i], batch[i])
                held.append(some.slice(i, j - i))
        if held:
            yield _one(held)

    dealt = rows.repartition("epoch", "batch").sortWithinPartitions("epoch", "batch")
    return dealt.mapInArrow(lambda arrow: fn(whole(arrow)), schema)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
