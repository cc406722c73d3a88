"""End-to-end quantisation of pixel relations: one row per image."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import dither, histogram, palette, remap, stencil
from ..sources import png
from ..sources.shared import written
from .views import with_internal


@dataclass(frozen=True)
class Options:
    """Quality range, speed 1..11, dither level 0..1, posterise bits, size gate, colours."""

    min_quality: int = 0
    max_quality: int = 100
    speed: int = 4
    dither: float = 1.0
    posterize: int = 0
    skip_if_larger: bool = False
    max_colours: int = 256
    use_importance: bool | None = None  # None: by the speed

    def __post_init__(self):
        if not (0 <= self.min_quality <= self.max_quality <= 100 and 1 <= self.speed <= 11 and 0 <= self.dither <= 1 and 0 <= self.posterize <= 4 and 2 <= self.max_colours <= 256):
            raise ValueError("options outside their ranges")

    @property
    def dither_level(self) -> float:
        return 0.0 if self.speed >= 11 else self.dither

    @property
    def input_bits(self) -> int:
        return min(max(self.posterize, 1 if self.speed >= 8 else 0), 3)

    @property
    def contrast(self) -> bool:
        return self.speed <= 7 if self.use_importance is None else self.use_importance

    @property
    def dither_map(self) -> str:
        return "always" if self.speed < 3 else "enabled" if self.speed <= 6 else "none"

    @property
    def most_entries(self) -> int:
        return 131072 + 262144 * (10 - min(self.speed, 10))


def _mse(quality: int) -> float:
    if quality <= 0:
        return 1e20
    if quality >= 100:
        return 0.0
    return 0.45 * (max(0.016 / (0.001 + quality) - 0.001, 0.0) + 2.5 / (210.0 + quality) ** 1.2 * (100.1 - quality) / 100.0)


#: Smallest side of an image that has maps; pixels beyond which its dither map is the edges alone.
SMALLEST, HUGE = 4, 2000 * 2000


def with_maps(px: DataFrame, options: Options) -> DataFrame:
    """``px`` with noise and edge by the contrast of internal colours; null edge where images have no maps."""
    none = {"noise": F.lit(255).cast("long"), "edge": F.lit(None).cast("long")}
    if not options.contrast and options.dither_map == "none":
        return px.withColumns(none)
    maps = stencil.importance_maps(with_internal(px), tuple(f"p{c}" for c in "rgba"), 1.0).select("image_id", "y", "x", "noise", "edge")
    large = px.groupBy("image_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y")).filter(f"_x >= {SMALLEST - 1} and _y >= {SMALLEST - 1}").select("image_id")
    got = px.join(maps.join(large, "image_id", "left_semi"), ["image_id", "y", "x"], "left")
    return got.withColumn("noise", F.coalesce("noise", none["noise"]) if options.contrast else none["noise"])


def histograms(px: DataFrame, options: Options) -> DataFrame:
    """Weighted entries of each image, weighed by noise; images with more entries than the speed allows lose one more bit."""
    weigh, bits = F.col("noise"), options.input_bits
    full = histogram.colour_histogram(px, bits, weigh)
    if bits < 3:
        crowded = full.groupBy("image_id").agg(F.count("*").alias("n")).filter(f"n > {options.most_entries}").select("image_id")
        coarse = histogram.colour_histogram(px.join(crowded, "image_id", "left_semi"), bits + 1, weigh)
        full = full.join(crowded, "image_id", "left_anti").unionByName(coarse)
    return histogram.finalized(full)


def rounded(palettes: DataFrame, bits: int) -> DataFrame:
    """image_id, idx, the bytes r, g, b, a that are written, and their internal colour q*."""
    out = E.to_rgba(E.colour("q"))
    colours = palettes.select("image_id", "idx", *(E.posterize_output(v, bits).alias(c) for c, v in zip("rgba", out)))
    shown = with_internal(colours, "q").select("image_id", "idx", "a", *"rgb", *(f"q{c}" for c in "argb"))
    return shown.withColumns({c: F.when(F.col("a") == 0, F.lit(v).cast("long")).otherwise(F.col(c)) for c, v in zip("rgb", E.TRANSPARENT_BYTES)})


def strengths(plain: DataFrame, options: Options) -> DataFrame:
    """strength of each pixel of a plain remap (idx, edge): the dither map, the edges of huge images, 255 where there is no map."""
    whole = plain.select("image_id", "y", "x", F.lit(255).cast("long").alias("strength"))
    if options.dither_map == "none":
        return whole
    mapped = plain.filter("edge is not null")
    if options.dither_map == "always":
        made = dither.dither_map(mapped.select("image_id", "y", "x", "idx", "edge"))
    else:
        huge = plain.groupBy("image_id").agg(F.count("*").alias("n")).filter(f"n > {HUGE}").select("image_id")
        made = dither.dither_map(mapped.join(huge, "image_id", "left_anti").select("image_id", "y", "x", "idx", "edge"))
        made = made.unionByName(mapped.join(huge, "image_id", "left_semi").select("image_id", "y", "x", F.col("edge").alias("strength")))
    return made.unionByName(whole.join(plain.filter("edge is null").select("image_id").distinct(), "image_id", "left_semi"))


def quantize(px: DataFrame, options: Options = Options(), files: DataFrame | None = None) -> DataFrame:
    """image_id, colours, mse, score, status, exit_code, size_bytes, content of each image of ``px`` (image_id, y, x, r, g, b, a).

    Colours are weighed by the contrast maps of the speed. With dithering the palette first moves to the means of its
    pixels and is then rounded; without, it is rounded first. Entries without a pixel are dropped, the others reordered.
    Images that come from ``files`` (image_id, metadata, in_bytes) keep their metadata, and the size gate compares with the
    file; where there is none, with four bytes a pixel.
    """
    search = palette.Search.of_speed(options.speed, options.max_colours, _mse(options.min_quality), _mse(options.max_quality), options.posterize)
    source = written(with_maps(px.select("image_id", "y", "x", *"rgba"), options), "maps")
    items = histograms(source, options)
    palettes = written(palette.search_palettes(with_internal(items).select("image_id", *(f"p{c}" for c in "argb"), "weight"), search), "palettes")

    own = with_internal(source)
    if options.dither_level > 0:
        plain = written(remap.nearest(own, palettes).select("image_id", "y", "x", "noise", "edge", "idx", "err"), "plain")
        fed = remap.feedback(own.join(plain.select("image_id", "y", "x", "idx", "err"), ["image_id", "y", "x"]), "noise")
        entries = written(rounded(remap.with_feedback(palettes, fed), options.posterize), "entries")
        # errors are bounded by those of the remap that made the dither map, or of the search where none is made
        errors = plain.groupBy("image_id").agg(F.avg("err").alias("error")) if options.dither_map != "none" else palettes.groupBy("image_id").agg(F.first("error").alias("error"))
        indexed = dither.diffused(own.join(strengths(plain, options), ["image_id", "y", "x"]), entries.join(errors, "image_id"), options.dither_level)
    else:
        entries = written(rounded(palettes, options.posterize), "entries")
        indexed = remap.nearest(own, entries).select("image_id", "y", "x", "idx")
    indexed = written(indexed, "indexed")

    order = remap.reordered(indexed, entries)
    colours = written(entries.join(order, ["image_id", "idx"]).select("image_id", F.col("new_idx").alias("idx"), F.col("idx").alias("old"), *"rgba"), "colours")
    moved = indexed.withColumnRenamed("idx", "old").join(colours.select("image_id", "old", "idx", *"rgba"), ["image_id", "old"])
    seen = with_internal(moved, "o").select("image_id", "y", "x", *(f"o{c}" for c in "argb"))
    scores = remap.quality(own.join(seen, ["image_id", "y", "x"]))
    encoded = png.encoded_images(moved, colours, options.speed, files).withColumn("size_bytes", F.length("content").cast("long"))
    counts = colours.groupBy("image_id").agg(F.count("*").alias("colours"))
    sizes = px.groupBy("image_id").agg((F.count("*") * 4).alias("in_bytes")) if files is None else files.select("image_id", "in_bytes")
    got = encoded.join(scores, "image_id").join(counts, "image_id").join(sizes, "image_id").withColumn("min_score", F.lit(options.min_quality))
    out_bytes = F.col("size_bytes") if options.skip_if_larger else F.lit(0)
    return remap.gated(got.withColumn("out_bytes", out_bytes)).select("image_id", "colours", "mse", "score", "status", "exit_code", "size_bytes", "content")
