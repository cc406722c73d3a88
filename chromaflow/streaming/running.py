"""Streams: histograms and run reports kept up to date with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def running_histogram(px: DataFrame, bits: int = 0) -> DataFrame:
    """Colour counts of a stream of pixels (image_id, r, g, b, a): partial aggregates per batch, sums as state. For update or complete mode."""
    masked = [E.posterize(F.col(c), bits) for c in "rgba"]
    return px.groupBy("image_id", E.colour_key(*masked).alias("key")).agg(E.saturating_sum(F.lit(255)).alias("importance"))


def windowed_report(runs: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs by event time: counts by conclusion and the summed sizes of each window; rows later than ``late`` are left out. ``runs``: created, conclusion, in_bytes, out_bytes."""
    is_ = lambda c: F.count_if(F.col("conclusion") == c)
    got = runs.withWatermark("created", late).groupBy(F.window("created", width).alias("w"))
    counted = got.agg(F.count("*").alias("total"), is_("success").alias("success"), is_("failure").alias("failure"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"))
    return counted.select(F.col("w.start").alias("start"), "total", "success", "failure", (F.col("out_bytes") / F.col("in_bytes")).alias("ratio"))
