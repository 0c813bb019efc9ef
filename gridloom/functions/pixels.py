"""Pixel operations on tables (image, y, x, c, v), in SQL; v is 0..255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channel means and deviations (red, green, blue) that classifiers expect.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)
# Weights of red, green and blue in grey, in thousandths.
GREY = (299, 587, 114)


def clipped(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v))).cast("int")


def brightness(v: Column, factor: Column | float) -> Column:
    return clipped(v * (factor if isinstance(factor, Column) else F.lit(factor)))


def contrast(pixels: DataFrame, factor: float) -> DataFrame:
    """Blend with the rounded mean of the image's grey values. Channels are red, green, blue."""
    weight = F.element_at(F.array(*(F.lit(w) for w in GREY)), F.col("c") + 1)
    grey = F.expr("cast((__l + 500) div 1000 as int)")
    pixels = pixels.repartition("image")  # one exchange, or that which is there already, serves spots, means and the join; nothing is sorted
    spots = pixels.groupBy("image", "y", "x").agg(F.sum(weight * F.col("v")).alias("__l"), F.count("*").alias("__n")).withColumn("__g", grey)
    rows = F.when(F.col("__g").isNotNull(), F.col("__n"))
    mean = spots.groupBy("image").agg(F.floor(F.sum(F.col("__g") * rows) / F.sum(rows) + 0.5).alias("__m"))
    d = pixels.join(mean.hint("shuffle_hash"), "image")  # told to: an exploded table is larger than the optimizer takes it for
    return d.withColumn("v", clipped(F.col("__m") + F.lit(factor) * (F.col("v") - F.col("__m")))).drop("__m")


def _reached(at: str, old: str, new: int) -> tuple[Column, Column]:
    """The first and the last of `new` places whose nearest of `old` places is `at`; the last is less than the first if there is none."""
    first = lambda k: f"({k} * {new} + {old} - 1) div {old}"
    return F.greatest(F.lit(0), F.expr(first(at))).cast("int"), F.least(F.lit(new), F.expr(first(f"({at} + 1)"))).cast("int") - 1


def nearest(pixels: DataFrame, height: Column, width: Column, new_height: int, new_width: int) -> DataFrame:
    """Resized to a larger or smaller grid by the nearest pixel (floor of the scaled place).

    Each pixel goes to the places that it is nearest of, so pixels meet one row of their image with its channels' sizes, not a grid; pixels that
    are dealt by image already stay where they are. The join is told to shuffle: the optimizer takes an exploded table for as small as what it
    was made of, and would broadcast it.
    """
    pixels = pixels.filter("c is not null").repartition("image")
    sizes = pixels.groupBy("image", "c").agg(F.max(height).cast("long").alias("h"), F.max(width).cast("long").alias("w"))
    sizes = sizes.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("h", "w")))).alias("s"))
    d = pixels.join(sizes.hint("shuffle_hash"), "image").withColumn("s", F.col("s")[F.col("c")]).select("image", "c", "y", "x", "v", "s.h", "s.w")
    (y0, y1), (x0, x1) = _reached("y", "h", new_height), _reached("x", "w", new_width)
    d = d.select("image", "c", "v", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).filter("y0 <= y1 and x0 <= x1")
    d = d.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return d.select("image", "y", "x", "c", "v")


def scaled(v: Column) -> Column:
    return v / F.lit(255.0)


def normalised(v: Column, c: Column) -> Column:
    mean, deviation = (F.element_at(F.array(*(F.lit(x) for x in xs)), c + 1) for xs in (MEAN, DEVIATION))
    return (scaled(v) - mean) / deviation


def flipped(x: Column, width: Column) -> Column:
    return width - 1 - x


def tile_of(y: Column, x: Column, height: Column, width: Column, rows: int = 3, cols: int = 3) -> Column:
    """The tile of a pixel, or null for what is left at the right and below."""
    r, c = F.floor(y / F.floor(height / rows)), F.floor(x / F.floor(width / cols))
    return F.when((r < rows) & (c < cols), r * cols + c).cast("int")
