"""Files in, files out: still images and animations of a folder, quantised in two relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import profile
from ..operators import remap
from ..sources import png
from ..sources.shared import written
from .animate import quantize_animations
from .quantize import Options, quantize

OUT = ("path", "frames", "colours", "mse", "score", "status", "exit_code", "size_bytes", "content")


def process_files(files: DataFrame, options: Options = Options(), mode: str = "safe") -> DataFrame:
    """path, frames, colours, mse, score, status, exit_code, size_bytes, content of each file (path, content).

    Files that cannot be decoded have status decode and no content. Colours are brought to sRGB first; metadata and play counts are
    kept, colours that were converted are stated as sRGB. Indexed animations
    keep their frames; those of them with frames smaller than the canvas are returned as they came, with score 100.
    ``path`` is unique; files are keyed by its 64-bit hash.
    """
    info = written(png.image_info(files).withColumn("id", F.xxhash64("path")), "info")
    ids = info.select("path", "id")
    bad = info.filter("status <> 'ok'").select("path", "status")
    ready = info.filter("status = 'ok'").join(files.select("path", "content"), "path")
    listed = png.animation_frames(ready)
    moving = listed.select("path").distinct()
    origin = written(info.drop("metadata").join(profile.kept_metadata(info), "path").join(files.select("path", F.length("content").cast("long").alias("in_bytes")), "path").select("id", "plays", "metadata", "in_bytes"), "origin")
    px = written(profile.normalised(png.image_pixels(ready), info), "file-pixels")

    still = px.join(moving, "path", "left_anti").join(ids, "path").select(F.col("id").alias("image_id"), "y", "x", *"rgba")
    singles = quantize(still, options, origin.withColumnRenamed("id", "image_id")).withColumnRenamed("image_id", "id").withColumn("frames", F.lit(1).cast("long"))

    settled = info.filter("is_indexed and has_subrect_frames")
    keyed = lambda df: df.join(ids, "path").withColumnRenamed("id", "anim").drop("path")
    todo = info.filter("status = 'ok'").join(moving, "path", "left_semi").join(settled.select("path"), "path", "left_anti")
    parts = []
    for own, optimise in ((todo.filter("not is_indexed"), True), (todo.filter("is_indexed"), False)):
        these = own.select("path")
        sizes = own.select(F.col("id").alias("anim"), "width", "height")
        frames, drawn = (written(keyed(df.join(these, "path", "left_semi")), "animation") for df in (listed, px))
        parts.append(quantize_animations(sizes, frames, drawn, options, mode, optimise, origin.withColumnRenamed("id", "anim")).withColumnRenamed("anim", "id"))
    columns = ["id", *OUT[1:]]
    done = singles.select(*columns).unionByName(parts[0].select(*columns)).unionByName(parts[1].select(*columns)).join(ids, "id").select(*OUT)
    same = settled.join(files.select("path", "content"), "path").withColumns({
        "score": F.lit(100).cast("long"), "min_score": F.lit(options.min_quality), "in_bytes": F.length("content").cast("long"), "size_bytes": F.length("content").cast("long"),
    }).withColumn("out_bytes", F.col("size_bytes") if options.skip_if_larger else F.lit(0))
    kept = remap.gated(same).withColumns({"colours": F.lit(None).cast("long"), "mse": F.lit(0.0)}).select(*OUT)
    none = {"frames": "long", "colours": "long", "mse": "double", "score": "long"}
    failed = bad.select("path", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "status", E.code_of(F.col("status")).alias("exit_code"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("binary").alias("content"))
    return done.unionByName(kept).unionByName(failed)
