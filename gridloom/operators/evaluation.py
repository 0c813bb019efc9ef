"""Losses, accuracy, precision and recall, and the best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Published series of ten epochs (training loss, validation loss, training accuracy, validation accuracy).
PUBLISHED = [
    (1, 0.3662, 0.2550, 0.8195, 0.9045),
    (2, 0.0940, 0.1744, 0.9749, 0.9397),
    (3, 0.0498, 0.1448, 0.9850, 0.9598),
    (4, 0.0211, 0.1059, 0.9975, 0.9648),
    (5, 0.0148, 0.1556, 0.9962, 0.9397),
    (6, 0.0163, 0.1274, 0.9950, 0.9598),
    (7, 0.0058, 0.1093, 1.0000, 0.9749),
    (8, 0.0062, 0.1394, 0.9987, 0.9548),
    (9, 0.0096, 0.1394, 0.9950, 0.9648),
    (10, 0.0160, 0.0947, 0.9950, 0.9648),
]


def losses(batches: DataFrame, *by: str) -> DataFrame:
    """weighted_loss (by rows) and mean_of_batches, which differ if a batch is short. batches: loss, n."""
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("weighted_loss"), F.avg("loss").alias("mean_of_batches"))


def confusion(predictions: DataFrame, *by: str, positive: int = 1) -> DataFrame:
    """n, tp, fp, fn, accuracy, precision and recall; the last two are 0 where their denominator is. predictions: pred, label."""
    p, y = F.col("pred") == positive, F.col("label") == positive
    d = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"),
        F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    part = lambda other: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), F.lit(0.0))
    return d.withColumns({"precision": part("fp"), "recall": part("fn")})


def best_epoch(epochs: DataFrame, epoch: str = "epoch", score: str = "val_acc") -> DataFrame:
    """The epoch with the best score over 0, the earliest of equals; no row if there is none."""
    top = epochs.filter(F.col(score) > 0).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e"))).alias("top"))
    return top.filter("top is not null").select((-F.col("top.e")).alias(epoch), F.col("top.s").alias(score))


def improvements(epochs: DataFrame, epoch: str = "epoch", score: str = "val_acc") -> DataFrame:
    """epochs (a row each, so few) with best_before (0 at first) and improved, which is strict."""
    before = F.coalesce(F.max(score).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return epochs.withColumn("best_before", before).withColumn("improved", F.col(score) > F.col("best_before"))


def report(epochs: DataFrame) -> DataFrame:
    """epoch, line: a readable line for each epoch and phase. epochs: epoch, phase, loss, acc."""
    line = F.format_string("%-5s loss: %.4f acc: %.4f", F.initcap("phase"), F.col("loss"), F.col("acc"))
    return epochs.select("epoch", line.alias("line"))
