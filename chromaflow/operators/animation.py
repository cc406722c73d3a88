"""Whole animations: folding repeated frames, shrinking frames to what changes, trimming them.

Relations: ``sizes`` (anim, width, height), ``frames`` (anim, frame_no from 0, w, h, x_off,
y_off, delay_num, delay_den, dispose, blend), ``drawn`` (anim, frame_no, y, x inside the
frame, r, g, b, a; frame_no -1 is a default image that is no frame).

Cells of a canvas are independent, so composing shuffles pixels once by cell and all that
follows compares neighbours in a cell's own list; a frame's decision is an aggregate of its
cells. Only the list of one animation's frames (no pixels) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.shared import written
from .frames import canvas_cells, composed, content_bounds, same_composites

KEY = ["anim", "frame_no"]


def _changes(composites: DataFrame) -> DataFrame:
    """Composites with ``changed``: does the cell differ from the frame before (true in the first)."""
    before = F.lag(F.struct(*"rgba")).over(Window.partitionBy("anim", "y", "x").orderBy("frame_no"))
    return composites.withColumn("changed", before.isNull() | (before != F.struct(*"rgba")))


def folded_frames(sizes: DataFrame, frames: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, drawn) where of frames in a row that look alike the first stays, with their delays merged in order; numbered anew."""
    seen = _changes(composed(canvas_cells(sizes), frames, drawn))
    moved = seen.groupBy(*KEY).agg(F.bool_or("changed").alias("changed"))
    run = F.sum(F.coalesce(F.col("changed"), F.lit(True)).cast("long")).over(Window.partitionBy("anim").orderBy("frame_no"))
    runs = frames.join(moved, KEY, "left").withColumn("run", run - 1)
    parts = F.array_sort(F.collect_list(F.struct("frame_no", F.col("delay_num").cast("long").alias("num"), F.col("delay_den").cast("long").alias("den"))))
    heads = runs.groupBy("anim", F.col("run").alias("new_no")).agg(F.min("frame_no").alias("frame_no"), parts.alias("parts"))

    def merge(s, f):
        num, den = E.merge_delays(s["num"], s["den"], f["num"], f["den"])
        return F.struct(num.alias("num"), den.alias("den"))

    first = F.element_at("parts", 1)
    total = F.aggregate(F.slice("parts", 2, F.size("parts")), F.struct(first["num"].alias("num"), first["den"].alias("den")), merge)
    merged = written(heads.select(*KEY, "new_no", total.alias("d")), "runs")
    kept = frames.join(merged, KEY).withColumns({"frame_no": F.col("new_no"), "delay_num": F.col("d.num"), "delay_den": F.col("d.den")}).drop("new_no", "d")
    numbers = merged.select(*KEY, "new_no").unionByName(frames.select("anim").distinct().select("anim", F.lit(-1).cast("long").alias("frame_no"), F.lit(-1).cast("long").alias("new_no")))
    pixels = drawn.join(numbers, KEY).withColumn("frame_no", F.col("new_no")).drop("new_no")
    return kept.select(*frames.columns), pixels.select(*drawn.columns)


def minimised_frames(sizes: DataFrame, frames: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, drawn) where each frame after the first holds only the box that changes, and replaces it; unverified.

    A frame that changes nothing becomes one transparent pixel in the corner.
    """
    return _minimised(_changes(composed(canvas_cells(sizes), frames, drawn)), frames, drawn)


def _minimised(seen: DataFrame, frames: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    box = seen.filter("changed and frame_no > 0").groupBy(*KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    placed = frames.join(box, KEY, "left")
    later, none = F.col("frame_no") > 0, F.col("x0").isNull()
    to = lambda old, gap, changed: F.when(~later, F.col(old).cast("long")).when(none, F.lit(gap).cast("long")).otherwise(changed)
    fresh = {"w": to("w", 1, F.col("x1") - F.col("x0") + 1), "h": to("h", 1, F.col("y1") - F.col("y0") + 1), "x_off": to("x_off", 0, F.col("x0")), "y_off": to("y_off", 0, F.col("y0"))}
    fresh |= {"dispose": F.when(later, F.lit("none")).otherwise(F.col("dispose")), "blend": F.when(later, F.lit("source")).otherwise(F.col("blend"))}
    kept = placed.withColumns(fresh).select(*frames.columns)

    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    cut = seen.join(box, KEY).filter(inside).select(*KEY, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *"rgba")
    zero = F.lit(0).cast("long")
    blank = placed.filter(later & none).select(*KEY, *(zero.alias(c) for c in ("y", "x", *"rgba")))
    whole = drawn.filter("frame_no <= 0").select(*KEY, "y", "x", *"rgba")
    return kept, whole.unionByName(cut).unionByName(blank)


def checked_minimised_frames(sizes: DataFrame, frames: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`minimised_frames` where an animation of which any composite would change keeps all its frames as they were."""
    cells = canvas_cells(sizes)
    seen = written(_changes(composed(cells, frames, drawn)), "composites")
    small_frames, small_drawn = (written(df, "minimised") for df in _minimised(seen, frames, drawn))
    verdict = written(same_composites(seen, composed(cells, small_frames, small_drawn)).select("anim", "same"), "verdicts")
    good, bad = verdict.filter("same").select("anim"), verdict.filter("not same").select("anim")
    pick = lambda new, old: new.join(good, "anim", "left_semi").unionByName(old.join(bad, "anim", "left_semi").select(*new.columns))
    return pick(small_frames, frames), pick(small_drawn, drawn)


def trimmed_frames(sizes: DataFrame, frames: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, drawn) where full-canvas frames that replace lose transparent rows and columns at the bottom and right; wholly transparent ones stay."""
    whole = (F.col("blend") == "source") & (F.col("w") == F.col("width")) & (F.col("h") == F.col("height")) & (F.col("x_off") == 0) & (F.col("y_off") == 0)
    fitting = frames.join(sizes.select("anim", "width", "height"), "anim").filter(whole).select(*KEY)
    unit = drawn.join(fitting, KEY, "left_semi").withColumn("_unit", F.struct(*KEY))
    bounds = content_bounds(unit, "_unit").select("_unit.*", F.col("width").alias("_w"), F.col("height").alias("_h"))
    kept = frames.join(bounds, KEY, "left").withColumns({"w": F.coalesce("_w", "w"), "h": F.coalesce("_h", "h")})
    pixels = drawn.join(bounds, KEY, "left").filter("(_w is null or x < _w) and (_h is null or y < _h)")
    return kept.select(*frames.columns), pixels.select(*drawn.columns)
