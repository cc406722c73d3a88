"""End-to-end quantisation of animations: one palette for all frames, one row per animation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import animation, dither, palette, remap
from ..operators.frames import UNDER, canvas_cells, composed
from ..sources import png
from ..sources.shared import written
from .quantize import Options, _mse, histograms
from .views import with_internal

KEY = ["anim", "frame_no"]
MODES = ("safe", "aggressive")


def global_palettes(frames: DataFrame, drawn: DataFrame, options: Options = Options()) -> DataFrame:
    """image_id (the anim), idx, q*: a palette of all frames and the default image.

    Where a frame blends over and there are more than two colours, one entry is reserved, and is transparent unless the
    palette has such an entry of its own.
    """
    search = palette.Search.of_speed(options.speed, options.max_colours, _mse(options.min_quality), _mse(options.max_quality), options.posterize)
    # frames in order, then the scan order in a frame: the first pixel of a colour stands for it
    px = drawn.select(F.col("anim").alias("image_id"), ((F.col("frame_no") + 1) * (1 << 32) + F.col("y")).alias("y"), "x", *"rgba", F.lit(255).cast("long").alias("noise"))
    items = with_internal(histograms(px, options)).select("image_id", *(f"p{c}" for c in "argb"), "weight")
    over = frames.filter("blend = 'over'").select(F.col("anim").alias("image_id")).distinct()
    if options.max_colours <= 2:
        return palette.search_palettes(items, search)
    fewer = replace(search, colours=search.colours - 1)
    reserved = palette.search_palettes(items.join(over, "image_id", "left_semi"), fewer)
    clear = E.is_transparent(E.colour("q"))
    lacking = reserved.groupBy("image_id").agg(F.count_if(clear).alias("clear"), F.count("*").alias("idx")).filter("clear = 0")
    zero = F.lit(0.0)
    extra = lacking.select("image_id", "idx", *(zero.alias(c) for c in ("qa", "qr", "qg", "qb", "popularity", "error")))
    return palette.search_palettes(items.join(over, "image_id", "left_anti"), search).unionByName(reserved).unionByName(extra)


def with_background(sizes: DataFrame, frames: DataFrame, drawn: DataFrame) -> DataFrame:
    """``drawn`` with the internal colour u* that lies under each pixel; nulls in frames that replace and in default images."""
    at = frames.select(*KEY, "x_off", "y_off", "blend")
    under = composed(canvas_cells(sizes), frames, drawn).select(*KEY, F.col("y").alias("_y"), F.col("x").alias("_x"), *UNDER)
    under = under.join(at.filter("blend = 'over'"), KEY).select(*KEY, (F.col("_y") - F.col("y_off")).alias("y"), (F.col("_x") - F.col("x_off")).alias("x"), *UNDER)
    seen = drawn.join(under, [*KEY, "y", "x"], "left")
    colour = E.internal(*(F.col(u) for u in UNDER))
    return seen.withColumns({f"u{c}": F.when(F.col(UNDER[0]).isNotNull(), v) for c, v in zip("argb", colour)}).drop(*UNDER)


def kept_where_as_near(indexed: DataFrame, palettes: DataFrame) -> DataFrame:
    """Nearest entries (idx, err, u*, p*) with the transparent entry where what lies under a pixel is as near as its entry."""
    clear = palettes.filter(E.is_transparent(E.colour("q"))).groupBy("image_id").agg(F.min("idx").alias("_clear"))
    gap = F.round(E.difference(E.colour("u"), E.colour()), 12)
    keep = F.col("_clear").isNotNull() & F.col("ua").isNotNull() & (gap <= F.col("err"))
    got = indexed.join(clear, "image_id", "left").withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return got.withColumn("idx", F.when(F.col("_keep"), F.col("_clear")).otherwise(F.col("idx"))).drop("_keep", "_clear")


def quantize_animations(sizes: DataFrame, frames: DataFrame, drawn: DataFrame, options: Options = Options(), mode: str = "safe", optimise: bool = True, files: DataFrame | None = None) -> DataFrame:
    """anim, frames, colours, mse, score (of the worst frame), status, exit_code, size_bytes, content of each animation.

    ``anim`` is a LONG. Repeated frames are folded; then ``mode`` safe trims transparent borders, aggressive shrinks frames
    to what changes where no composite changes. Files that are indexed already keep their frames: ``optimise`` False.
    Animations that come from ``files`` (anim, plays, metadata, in_bytes) keep both, and the size gate compares with the
    file; where there is none, with four bytes a pixel.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    in_bytes = drawn.groupBy("anim").agg((F.count("*") * 4).alias("in_bytes")) if files is None else files.select("anim", "in_bytes")
    if optimise:
        frames, drawn = animation.folded_frames(sizes, frames, drawn)
        frames, drawn = (animation.trimmed_frames if mode == "safe" else animation.checked_minimised_frames)(sizes, frames, drawn)
        frames, drawn = written(frames, "frames"), written(drawn, "drawn")
    palettes = written(global_palettes(frames, drawn, options), "palettes")
    rounded = E.to_rgba(E.Colour(*(F.col(f"q{c}") for c in "argb")))
    colours = palettes.select("image_id", "idx", *(E.posterize_output(v, options.posterize).alias(c) for c, v in zip("rgba", rounded)))
    # frames are matched against the palette as it is written
    entries = with_internal(colours, "q").select("image_id", "idx", *"rgba", *(f"q{c}" for c in "argb"))

    own = written(with_internal(with_background(sizes, frames, drawn)).withColumnRenamed("anim", "image_id"), "pixels")
    unit = ["image_id", "frame_no"]
    if options.dither_level > 0:
        strength = own.withColumn("strength", F.lit(255))
        indexed = dither.diffused(strength, entries, options.dither_level)
    else:
        indexed = kept_where_as_near(remap.nearest(own, entries), entries).select(*unit, "y", "x", "idx")
    indexed = written(indexed, "indexed")
    shown = indexed.join(entries.select("image_id", "idx", *(F.col(f"q{c}").alias(f"o{c}") for c in "argb")), ["image_id", "idx"])
    frames_only = own.filter("frame_no >= 0").join(shown, [*unit, "y", "x"])
    scores = frames_only.groupBy(*unit).agg(F.avg(E.difference(E.colour(), E.colour("o"))).alias("mse")).withColumn("score", E.mse_to_quality(F.col("mse")))
    worst = scores.groupBy("image_id").agg(F.min_by(F.struct("score", "mse"), F.struct("score", "frame_no")).alias("w"), F.count("*").alias("frames"))
    worst = worst.select(F.col("image_id").alias("anim"), "frames", F.col("w.score").alias("score"), F.when(F.col("w.score") < 100, F.col("w.mse")).otherwise(0.0).alias("mse"))

    named = lambda df: df.withColumnRenamed("image_id", "anim")
    encoded = png.encoded_animations(named(indexed), frames, named(entries), sizes, options.speed, files).withColumn("size_bytes", F.length("content").cast("long"))
    counts = named(entries).groupBy("anim").agg(F.count("*").alias("colours"))
    got = encoded.join(worst, "anim").join(counts, "anim").join(in_bytes, "anim").withColumn("min_score", F.lit(options.min_quality))
    out_bytes = F.col("size_bytes") if options.skip_if_larger else F.lit(0)
    return remap.gated(got.withColumn("out_bytes", out_bytes)).select("anim", "frames", "colours", "mse", "score", "status", "exit_code", "size_bytes", "content")
