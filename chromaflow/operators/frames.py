"""Animation frames: folds over frames in order, as gaps and islands, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E

UNDER = tuple(f"under_{c}" for c in "rgba")


def changed_rectangles(px: DataFrame) -> DataFrame:
    """Per frame after the first: the box of pixels that differ from the frame before, and their number. ``px``: frame_no, y, x, r, g, b, a."""
    before = px.select((F.col("frame_no") + 1).alias("frame_no"), "y", "x", *(F.col(c).alias(f"_{c}") for c in "rgba"))
    same = [F.col(c) == F.col(f"_{c}") for c in "rgba"]
    differ = px.join(before, ["frame_no", "y", "x"]).filter(~(same[0] & same[1] & same[2] & same[3]))
    box = {"x0": F.min("x"), "y0": F.min("y"), "x1": F.max("x"), "y1": F.max("y"), "pixels": F.count("*")}
    return differ.groupBy("frame_no").agg(*(v.alias(k) for k, v in box.items()))


def folded(frames: DataFrame, key: str, order: str, content: str, weight: str) -> DataFrame:
    """Runs of equal ``content`` in order: first place, length, summed ``weight``."""
    w = Window.partitionBy(key).orderBy(*order.split(","))
    new = F.when(F.lag(content).over(w).eqNullSafe(F.col(content)), 0).otherwise(1)
    runs = frames.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("long"))
    return runs.groupBy(key, "run").agg(F.first(content).alias(content), F.count("*").alias("frames"), F.sum(weight).alias("total"))


def composed_source(px: DataFrame) -> DataFrame:
    """Canvas after each frame where frames replace (no disposal): a transparent pixel (a = 0 after posterising) shows the last one drawn."""
    w = Window.partitionBy("y", "x").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("a") > 0, F.struct(*"rgba")), ignorenulls=True).over(w)
    return px.withColumn("_c", last).select("frame_no", "y", "x", *(F.coalesce(F.col(f"_c.{c}"), F.lit(0).cast("long")).alias(c) for c in "rgba"))


def canvas_cells(sizes: DataFrame) -> DataFrame:
    """anim, y, x of every cell of the canvases (anim, width, height); none of empty ones."""
    rows = sizes.filter("width > 0 and height > 0").select("anim", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y"))
    return rows.select("anim", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("x"))


def composed(canvas: DataFrame, frames: DataFrame, drawn: DataFrame) -> DataFrame:
    """Canvas after each frame (r, g, b, a) and before it was drawn (under_r ...): dispose of the frame before, then copy or blend.

    ``canvas``: anim, y, x (every cell); ``frames``: anim, frame_no, w, h, x_off, y_off,
    dispose (none, background, previous), blend (source, over); ``drawn``: anim, frame_no,
    y, x (in the frame), r, g, b, a. Cells are independent: each folds its own frames.
    """
    frames = frames.withColumn("dispose", E.effective_dispose(F.col("dispose"), F.col("frame_no")))
    cells = canvas.join(frames, "anim")
    inside = F.col("x").between(F.col("x_off"), F.col("x_off") + F.col("w") - 1) & F.col("y").between(F.col("y_off"), F.col("y_off") + F.col("h") - 1)
    placed = drawn.join(frames.select("anim", "frame_no", "x_off", "y_off"), ["anim", "frame_no"])
    placed = placed.select("anim", "frame_no", (F.col("y") + F.col("y_off")).alias("y"), (F.col("x") + F.col("x_off")).alias("x"), F.struct(*(F.col(c).cast("long").alias(c) for c in "rgba")).alias("c"))
    steps = cells.withColumn("inside", inside).join(placed, ["anim", "frame_no", "y", "x"], "left")
    ordered = steps.groupBy("anim", "y", "x").agg(F.array_sort(F.collect_list(F.struct("frame_no", "inside", "dispose", "blend", "c"))).alias("steps"))
    blank = F.struct(*(F.lit(0).cast("long").alias(c) for c in "rgba"))
    start = F.struct(blank.alias("now"), blank.alias("saved"), F.lit("none").alias("dispose"), F.lit(False).alias("inside"), F.array().cast(f"array<struct<frame_no:long,{','.join(f'{c}:long' for c in (*'rgba', *UNDER))}>>").alias("out"))

    def step(s, f):
        cleared = F.when(s["inside"] & (s["dispose"] == "background"), blank).when(s["inside"] & (s["dispose"] == "previous"), s["saved"]).otherwise(s["now"])
        over = E.blend_over({c: f["c"][c] for c in "rgba"}, {c: cleared[c] for c in "rgba"})
        drawn_ = F.when(f["inside"] & (f["blend"] == "source"), f["c"]).when(f["inside"], F.struct(*(over[c].alias(c) for c in "rgba"))).otherwise(cleared)
        row = F.struct(f["frame_no"].cast("long").alias("frame_no"), *(drawn_[c].alias(c) for c in "rgba"), *(cleared[c].alias(u) for c, u in zip("rgba", UNDER)))
        return F.struct(drawn_.alias("now"), cleared.alias("saved"), f["dispose"].alias("dispose"), f["inside"].alias("inside"), F.concat(s["out"], F.array(row)).alias("out"))

    return ordered.select("anim", "y", "x", F.inline(F.aggregate("steps", start, step, lambda s: s["out"])))


def content_bounds(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Smallest width and height from the corner that hold all pixels with alpha; the whole size if there are none."""
    w, h = F.max(F.col("x") + 1), F.max(F.col("y") + 1)
    some = F.col("a") > 0
    return px.groupBy(key).agg(
        F.coalesce(F.max(F.when(some, F.col("x") + 1)), w).alias("width"), F.coalesce(F.max(F.when(some, F.col("y") + 1)), h).alias("height")
    )


def same_composites(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per animation: are all composed frames equal, pixel by pixel."""
    key = ["anim", "frame_no", "y", "x"]
    both = one.join(other.select(*key, *(F.col(c).alias(f"_{c}") for c in "rgba")), key, "full")
    same = F.lit(True)
    for c in "rgba":
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.groupBy("anim").agg(F.bool_and(same).alias("same"), F.count_if(~same).alias("differing"))


def mismatches(one: DataFrame, other: DataFrame, most: int = 10) -> DataFrame:
    """Frames whose composites differ: anim, frame_no, differing cells, and the first ``most`` of them as (y, x)."""
    key = ["anim", "frame_no", "y", "x"]
    both = one.join(other.select(*key, *(F.col(c).alias(f"_{c}") for c in "rgba")), key, "full")
    differ = both.filter(~(F.struct(*"rgba").eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in "rgba")))))
    place = F.row_number().over(Window.partitionBy("anim", "frame_no").orderBy("y", "x"))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("y", "x"))))
    return differ.withColumn("_n", place).groupBy("anim", "frame_no").agg(F.count("*").alias("differing"), shown.alias("cells"))
