"""Colour histograms: two-phase hash aggregation of pixels by colour key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E


def colour_histogram(px: DataFrame, bits: int = 0, importance: Column | None = None, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Per image and posterised colour key: importance (255 a pixel without a map; stops at 2**32 - 1), first representative in scan order, its cluster."""
    masked = px.withColumns({c: E.posterize(F.col(c), bits) for c in "rgba"}) if bits else px
    importance = F.lit(255).cast("long") if importance is None else importance
    keyed = masked.select(*by, E.colour_key(*(F.col(c) for c in "rgba")).alias("key"), importance.alias("imp"), F.struct("y", "x").alias("at"), F.struct(*"rgba").alias("c"))
    grouped = keyed.groupBy(*by, "key").agg(E.saturating_sum(F.col("imp")).alias("importance"), F.min_by("c", "at").alias("c"))
    return grouped.select(*by, "key", "importance", *(F.col(f"c.{k}").alias(k) for k in "rgba"), E.cluster(*(F.col(f"c.{k}") for k in "rgba")).alias("cluster"))


def rekeyed(histogram: DataFrame, bits: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A coarser histogram: ``importance`` of the entry with the largest key (entries that collide overwrite), ``summed`` of all."""
    coarse = E.colour_key(*(E.posterize(F.col(c), bits) for c in "rgba"))
    return histogram.withColumn("coarse", coarse).groupBy(*by, "coarse").agg(F.max_by("importance", "key").alias("importance"), E.saturating_sum(F.col("importance")).alias("summed"))


def merged(histogram: DataFrame) -> DataFrame:
    """One histogram of all frames."""
    return histogram.groupBy("key").agg(E.saturating_sum(F.col("importance")).alias("importance"), F.count("*").alias("frames"))


def finalized(histogram: DataFrame) -> DataFrame:
    """Entries with importance, weighted: importance / 255, at most a tenth of the image's total."""
    kept = histogram.filter("importance > 0")
    total = kept.groupBy("image_id").agg((F.sum("importance") / 255.0).alias("total"))
    weighed = kept.join(total, "image_id")
    return weighed.withColumn("weight", F.least(F.col("importance") / 255.0, 0.1 * F.col("total")))


def with_transparent(weighted: DataFrame) -> DataFrame:
    """Adds a transparent entry of a tenth of the mean weight (1e-6 at least) to images that have none."""
    lacking = weighted.groupBy("image_id").agg(F.count_if(F.col("a") == 0).alias("clear"), F.avg("weight").alias("mean")).filter("clear = 0")
    zero = F.lit(0).cast("long")
    extra = lacking.select("image_id", *(zero.alias(c) for c in ("key", *"rgba", "cluster")), F.greatest(0.1 * F.col("mean"), F.lit(1e-6)).alias("weight"))
    return weighted.select("image_id", "key", *"rgba", "cluster", "weight").unionByName(extra)


def cluster_counts(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("image_id", "cluster").agg(F.count("*").alias("entries"), F.sum("importance").alias("importance"))


def first_of_importance(px_internal: DataFrame, px_external: DataFrame) -> DataFrame:
    """Elementwise smaller importance of two planes; the one there is where the other lacks the pixel."""
    key = ["image_id", "y", "x"]
    both = px_internal.select(*key, F.col("importance").alias("i")).join(px_external.select(*key, F.col("importance").alias("e")), key, "full")
    return both.select(*key, F.least("i", "e").alias("importance"))


def in_scan_order() -> Window:
    return Window.partitionBy("image_id").orderBy("y", "x")
