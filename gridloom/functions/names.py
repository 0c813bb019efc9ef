"""File names that carry ids and variants, and natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANTS = ("original", "night", "rain")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def padded_id(image_id: Column) -> Column:
    """Twelve digits or more, never cut."""
    return F.format_string("%012d", image_id)


def variant_name(image_id: Column, variant: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), padded_id(image_id), F.lit("_"), variant, F.lit(".jpg"))


def scene_name(weather: Column, timeofday: Column, name: Column) -> Column:
    return F.concat(F.lit("bdd_"), F.coalesce(weather, F.lit("")), F.lit("_"), F.coalesce(timeofday, F.lit("")), F.lit("_"), name)


def leading_id(name: Column) -> Column:
    """The number before the first underscore, or null."""
    return F.split_part(name, F.lit("_"), F.lit(1)).try_cast("bigint")


def stripped(text: Column) -> Column:
    """Without blanks at either end, Unicode ones included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers: an array of (text, number)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\D*)(\d*)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\D*", 0).alias("text"), F.coalesce(F.nullif(F.regexp_extract(p, r"\d*$", 0), F.lit("")), F.lit("-1")).try_cast("decimal(38,0)").alias("number")))
