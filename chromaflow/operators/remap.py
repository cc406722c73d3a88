"""Pixels and palettes: nearest entries, lookups, feedback, scores.

A palette has at most 256 entries an image, so a nearest-neighbour join collects it
into one array row per image (bounded) and folds over it inside the pixel's row: no
pair is materialised. Palettes grow with the number of images, so no join forces a
broadcast: Spark picks one by the palettes' size, and splits the image that is skewed
where it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E

MOST_COLOURS = 256


def palette_arrays(palette: DataFrame) -> DataFrame:
    """image_id and its entries (idx, internal colour) in order of idx."""
    entries = F.array_sort(F.collect_list(F.struct("idx", *(f"q{c}" for c in "argb"))))
    return palette.groupBy("image_id").agg(entries.alias("entries"))


def nearest(px: DataFrame, palette: DataFrame, digits: int = 12) -> DataFrame:
    """``px`` (internal colour p*) with idx and err of the nearest entry of its image's ``palette`` (idx, q*); the smaller idx on ties."""
    own = E.colour()

    def closer(best, entry):
        err = F.round(E.difference(own, E.Colour(*(entry[f"q{c}"] for c in "argb"))), digits)
        return F.when(err < best["err"], F.struct(err.alias("err"), entry["idx"].alias("idx"))).otherwise(best)

    start = F.struct(F.lit(1e30).alias("err"), F.lit(None).cast("long").alias("idx"))
    found = px.join(palette_arrays(palette), "image_id").withColumn("_best", F.aggregate("entries", start, closer))
    return found.select(*px.columns, F.col("_best.idx").alias("idx"), F.col("_best.err").alias("err"))


def looked_up(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with the palette's bytes out_r, out_g, out_b, out_a for their idx."""
    colours = palette.select("image_id", "idx", *(F.col(c).alias(f"out_{c}") for c in "rgba"))
    return indexed.join(colours, ["image_id", "idx"])


def feedback(indexed: DataFrame, importance: str | None = None) -> DataFrame:
    """Per image and idx: pixels, importance-weighted mean colour and mean error."""
    w = F.col(importance) if importance else F.lit(1.0)
    means = [(F.sum(F.col(f"p{c}") * w) / F.sum(w)).alias(f"m{c}") for c in "argb"]
    return indexed.groupBy("image_id", "idx").agg(F.count("*").alias("n"), *means, F.avg("err").alias("mean_err"))


def with_feedback(palette: DataFrame, means: DataFrame, fixed_clear: bool = True) -> DataFrame:
    """The palette moved to the means of its pixels; unused entries stay, the transparent one too if asked."""
    got = palette.join(means.select("image_id", "idx", *(f"m{c}" for c in "argb")), ["image_id", "idx"], "left")
    clear = E.is_transparent(E.colour("q")) if fixed_clear else F.lit(False)
    return got.select("image_id", "idx", *(F.when(clear, F.col(f"q{c}")).otherwise(F.coalesce(f"m{c}", f"q{c}")).alias(f"q{c}") for c in "argb"))


def kmeans_step(items: DataFrame, palette: DataFrame) -> DataFrame:
    """One assign-and-average step over weighted histogram items (p*, weight): new q*, popularity, error."""
    indexed = nearest(items, palette)
    w = F.col("weight")
    sums = indexed.groupBy("image_id", "idx").agg(F.sum(w).alias("popularity"), *(F.sum(F.col(f"p{c}") * w).alias(f"s{c}") for c in "argb"), F.sum(F.col("err") * w).alias("error"))
    moved = sums.filter("popularity > 0")
    return moved.select("image_id", "idx", "popularity", "error", *((F.col(f"s{c}") / F.col("popularity")).alias(f"q{c}") for c in "argb"))


def used_entries(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("image_id", "idx").agg(F.count("*").alias("n"))


def reordered(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Output palette: used entries only, non-opaque first, then by count; ``new_idx`` by old ``idx``."""
    used = used_entries(indexed).join(palette, ["image_id", "idx"])
    order = Window.partitionBy("image_id").orderBy((F.col("a") < 255).desc(), F.desc("n"), "idx")
    return used.withColumn("new_idx", (F.row_number().over(order) - 1).cast("long")).select("image_id", "idx", "new_idx", "n")


def sorted_palette(palette: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy((F.col("a") < 255).desc(), F.desc("popularity"), "idx")
    return palette.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def quality(px: DataFrame, other: str = "o") -> DataFrame:
    """Per image: mean squared error of internal colours p* against ``other``*, in the standard scale, and its score."""
    got = px.groupBy("image_id").agg(F.avg(E.difference(E.colour(), E.colour(other))).alias("mse"))
    return got.select("image_id", "mse", E.standard_mse(F.col("mse")).alias("standard_mse"), E.mse_to_quality(F.col("mse")).alias("score"))


def worst_frame(scores: DataFrame) -> DataFrame:
    """The lowest score of all frames, the first on ties, with its error."""
    return scores.agg(F.min_by(F.struct("score", "mse", "image_id"), F.struct("score", "image_id")).alias("w")).select("w.*")


def gated(results: DataFrame) -> DataFrame:
    """status and exit_code by the quality gate, then the size gate: score, min_score, out_bytes, in_bytes, quality."""
    status = (
        F.when(F.col("score") < F.col("min_score"), "quality_too_low").when(F.col("out_bytes") > E.most_bytes(F.col("in_bytes"), F.col("score")), "output_too_large").otherwise("ok")
    )
    return results.withColumn("status", status).withColumn("exit_code", E.code_of(F.col("status")))


def packed_rows(indexed: DataFrame, depth: int) -> DataFrame:
    """Bytes of each row with ``depth`` bits a pixel, most significant first, rows padded."""
    bit = F.col("x") * depth
    value = F.col("idx") * F.pow(F.lit(2.0), (8 - depth - bit % 8).cast("double")).cast("long")
    return indexed.groupBy("image_id", "y", F.floor(bit / 8).cast("long").alias("at")).agg(F.sum(value).cast("long").alias("byte"))
