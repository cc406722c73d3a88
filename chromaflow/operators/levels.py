"""Uniform levels: channels rounded to evenly spaced values, with or without error diffusion in raster order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = "image_id long, y long, x long, r long, g long, b long, a long"


def levels_of(quality: Column, speed: Column) -> Column:
    """Levels of a colour channel, 2 to 32, by quality 0..100 and speed."""
    fine = 2 + F.floor(quality * 30 / 100)
    return F.least(F.greatest(fine - F.floor(F.greatest(speed - 1, F.lit(0)) * 8 / 10), F.lit(2)), F.lit(32)).cast("long")


def alpha_levels_of(levels: Column) -> Column:
    return F.greatest(F.floor(levels / 2), F.lit(4)).cast("long")


def on_level(byte: Column, levels: Column) -> Column:
    """The value of ``levels`` evenly spaced ones nearest to a byte, halves upwards."""
    steps = F.greatest(levels - 1, F.lit(1)).cast("double")
    level = F.floor(byte / 255.0 * steps + 0.5)
    return F.when(levels <= 1, byte).otherwise(F.floor(level / steps * 255.0 + 0.5)).cast("long")


def levelled(px: DataFrame, levels: Column) -> DataFrame:
    """image_id, y, x, r, g, b, a with colours on ``levels`` and alpha on half as many."""
    shown = {c: on_level(F.col(c), levels) for c in "rgb"} | {"a": on_level(F.col("a"), alpha_levels_of(levels))}
    return px.select("image_id", "y", "x", *(v.alias(c) for c, v in shown.items()))


def levelled_diffused(px: DataFrame, levels: int) -> DataFrame:
    """As :func:`levelled`, the colours' errors diffused to the right and down. One image is one task: its rows are a chain."""
    alpha = max(levels // 2, 4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h = int(pdf["y"].nunique())
        own = pdf[list("rgb")].to_numpy(float).reshape(h, -1, 3)
        out = diffuse(own, levels)
        a = np.floor(np.floor(pdf["a"].to_numpy(float) / 255 * (alpha - 1) + 0.5) / (alpha - 1) * 255 + 0.5)
        flat = out.reshape(-1, 3).astype(np.int64)
        return pdf[["image_id", "y", "x"]].assign(**dict(zip("rgb", flat.T)), a=a.astype(np.int64))

    return px.select("image_id", "y", "x", *"rgba").groupBy("image_id").applyInPandas(run, PIXEL)


def diffuse(own: np.ndarray, levels: int) -> np.ndarray:
    """Values on ``levels`` of (h, w, 3) bytes; sevenths, threes, fives and ones of sixteen go right, down left, down, down right."""
    steps = max(levels - 1, 1)
    h, w, _ = own.shape
    out, carry = np.zeros_like(own), np.zeros((w + 2, 3))
    for y in range(h):
        below = np.zeros((w + 2, 3))
        for x in range(w):
            wanted = own[y, x] + carry[x + 1]
            bounded = np.clip(wanted, 0, 255)
            out[y, x] = np.floor(bounded + 0.5) if levels <= 1 else np.floor(np.floor(bounded / 255 * steps + 0.5) / steps * 255 + 0.5)
            error = wanted - out[y, x]
            carry[x + 2] += error * (7 / 16)
            below[x] += error * (3 / 16)
            below[x + 1] += error * (5 / 16)
            below[x + 2] += error * (1 / 16)
        carry = below
    return out
