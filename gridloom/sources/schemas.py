"""Explicit schemas (DDL) of the inputs; only fields that are used, so readers can prune the others."""

from __future__ import annotations

#: One JSON object with three arrays. `segmentation` is polymorphic and left out.
COCO = (
    "images array<struct<id: bigint, width: int, height: int, coco_url: string>>,"
    " annotations array<struct<image_id: bigint, category_id: bigint, area: double>>,"
    " categories array<struct<id: bigint, name: string>>"
)
#: One JSON array of items; every nested part may be missing.
ROAD_SCENES = "name string, attributes struct<weather: string, timeofday: string>, labels array<struct<category: string>>"
#: Spark's image struct; data is BGR, rows from the top.
RASTER = "origin string, height int, width int, nChannels int, mode int, data binary"
BOX = "x_min double, y_min double, x_max double, y_max double"
FETCHED = "content binary, error string"
