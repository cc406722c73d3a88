"""Neighbourhood operators: windows over a row or a column of pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_x():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def second_difference(c: Column, over) -> Column:
    """|2c - before - after|, with edges repeated."""
    return F.abs(2 * c - F.coalesce(F.lag(c).over(over), c) - F.coalesce(F.lead(c).over(over), c))


def contrast(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), whole: float = 255.0) -> DataFrame:
    """noise and edge (0..255) of each pixel from the largest second difference of any channel (0..``whole``)."""
    across = reduce(F.greatest, [second_difference(F.col(c) / whole, along_x()) for c in channels])
    down = reduce(F.greatest, [second_difference(F.col(c) / whole, along_y()) for c in channels])
    got = px.withColumn("h", across).withColumn("v", down)
    edge = F.greatest("h", "v")
    z = 1 - F.greatest(edge - F.abs(F.col("h") - F.col("v")) * 0.5, F.least("h", "v"))
    z2 = F.greatest(z, F.lit(0.0)) * F.greatest(z, F.lit(0.0))
    noise = F.least(F.floor(z2 * z2 * 176.0 + 80.0 + 1e-9), F.lit(255)).cast("long")
    plane = F.least(F.greatest(F.floor((1 - edge) * 256.0 + 1e-9), F.lit(0)), F.lit(255)).cast("long")
    return got.select("image_id", "y", "x", F.round("h", 9).alias("h"), F.round("v", 9).alias("v"), noise.alias("noise"), plane.alias("edge"))


def plus_extreme(plane: DataFrame, column: str, largest: bool) -> DataFrame:
    """The largest (smallest) of a pixel and its four neighbours."""
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    c = F.col(column)
    return plane.withColumn(column, pick(agg(c).over(along_x().rowsBetween(-1, 1)), agg(c).over(along_y().rowsBetween(-1, 1))))


def blurred(plane: DataFrame, column: str, over, axis: str) -> DataFrame:
    """Whole mean of the six values at offsets -2..+3 along an axis, edges repeated."""
    c = F.col(column)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, last = F.col(axis), F.max(axis).over(whole)
    first_value, last_value = F.first(c).over(whole), F.last(c).over(whole)
    before = F.greatest(F.lit(0), 2 - place) * first_value
    after = F.greatest(F.lit(0), place + 3 - last) * last_value
    total = F.sum(c).over(over.rowsBetween(-2, 3)) + before + after
    return plane.withColumn(column, F.floor(total / 6).cast("long"))


def importance_maps(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), whole: float = 255.0) -> DataFrame:
    """noise and edge planes after the chain of maxima, blur and minima."""
    plane = contrast(px, channels, whole).select("image_id", "y", "x", "noise", "edge")
    for largest in (True, True):
        plane = plus_extreme(plane, "noise", largest)
    plane = blurred(blurred(plane, "noise", along_x(), "x"), "noise", along_y(), "y")
    for largest in (True, False, False, False):
        plane = plus_extreme(plane, "noise", largest)
    for largest in (False, True):
        plane = plus_extreme(plane, "edge", largest)
    return plane.withColumn("edge", F.least("edge", "noise"))
