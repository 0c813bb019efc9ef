"""Grids of tiles, and labels of tiles by the boxes that overlap them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ("x_min", "y_min", "x_max", "y_max")


def grid(images: DataFrame, rows: int = 3, cols: int = 3) -> DataFrame:
    """image columns with index, x_min, y_min, x_max, y_max of each whole tile; what is left at the right and below is in none.

    images: width, height and more. Tiles are numbered along rows, from 0.
    """
    w, h = F.expr(f"width div {cols}"), F.expr(f"height div {rows}")
    d = images.withColumns({"__w": w, "__h": h}).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    row, col = F.expr(f"index div {cols}"), F.col("index") % cols
    edges = {"x_min": col * F.col("__w"), "y_min": row * F.col("__h"), "x_max": (col + 1) * F.col("__w"), "y_max": (row + 1) * F.col("__h")}
    return d.withColumns({k: v.cast("int") for k, v in edges.items()}).drop("__w", "__h")


def overlaps(t: DataFrame | dict[str, Column], b: DataFrame | dict[str, Column]) -> Column:
    """Strictly: edges that only touch do not count; a box without area inside a tile does."""
    return (t["x_min"] < b["x_max"]) & (t["x_max"] > b["x_min"]) & (t["y_min"] < b["y_max"]) & (t["y_max"] > b["y_min"])


def labelled(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """tiles (image_id, index and edges) with label 1 where a box (image_id and edges) of the image overlaps, else 0.

    One join that only asks whether there is a box. It is told to sort and merge: compressed or exploded boxes are many more than the optimizer
    takes them for, and would be broadcast.
    """
    t = tiles.alias("__t")
    mine, box = ({c: make(c) for c in ("image_id", *EDGES)} for make in (lambda c: F.col(f"__t.{c}").outer(), lambda c: F.col(f"__b.{c}")))
    hit = boxes.alias("__b").where((mine["image_id"] == box["image_id"]) & overlaps(mine, box)).hint("merge").exists()
    return t.select(*(F.col(f"__t.{c}") for c in tiles.columns), F.when(hit, 1).otherwise(0).alias("label"))


def labelled_arrays(tiles: DataFrame, boxes: str = "boxes") -> DataFrame:
    """The same where each tile row has its image's boxes as an array: no join."""
    hit = F.exists(boxes, lambda b: (F.col("x_min") < b["x_max"]) & (F.col("x_max") > b["x_min"]) & (F.col("y_min") < b["y_max"]) & (F.col("y_max") > b["y_min"]))
    return tiles.withColumn("label", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))


def slots(found: DataFrame, many: int = 9, missing: str = "missing") -> DataFrame:
    """One row for each of `many` tiles in order: that of found (tile, mark), or the marker."""
    every = found.sparkSession.range(many).select(F.col("id").cast("int").alias("tile"))
    return every.join(found, "tile", "left").withColumn("status", F.when(F.col("mark").isNull(), missing).otherwise("ok")).withColumn("mark", F.coalesce("mark", F.lit(missing)))


def as_grid(cells: DataFrame, by: str, index: str, value: str, cols: int = 3) -> DataFrame:
    """by, row and a column c0, c1, ... for each place in the row."""
    d = cells.withColumns({"row": F.expr(f"cast({index} div {cols} as int)"), "__c": F.col(index) % cols})
    return d.groupBy(by, "row").agg(*(F.max(F.when(F.col("__c") == c, F.col(value))).alias(f"c{c}") for c in range(cols)))
