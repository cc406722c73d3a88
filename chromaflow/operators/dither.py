"""Operators defined as an ordered scan of an image: dither map and serpentine error diffusion.

Images are cut into chunks of rows; a chunk replays the two rows before it, so chunks
run in parallel and a huge image is many tasks. The number of rows in a chunk is an
option, never the number of cores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .palette import differences

CHUNK_ROWS, WARM_ROWS = 128, 2
INDEXED = "image_id long, y long, x long, idx long"
MAPPED = "image_id long, y long, x long, strength long"


def dither_map(indexed: DataFrame) -> DataFrame:
    """strength (0..255) per pixel of (image_id, y, x, idx, edge): edges count more in long runs of one index that rows above and below share."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf["y"].nunique()), int(pdf["x"].nunique())
        out = run_strengths(pdf["idx"].to_numpy().reshape(h, w), pdf["edge"].to_numpy(np.int64).reshape(h, w))
        return pd.DataFrame({"image_id": pdf["image_id"], "y": pdf["y"], "x": pdf["x"], "strength": out.ravel()})

    return indexed.groupBy("image_id").applyInPandas(run, MAPPED)


def run_strengths(idx: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Strengths of an (h, w) image.

    A run goes from the pixel where its index begins to the pixel before the next run; the last of a row ends before the
    row's last pixel, whatever index that has. Its length and the pixels above and below that share its index give a
    factor for its pixels and for the one after it, which so is scaled twice.
    """
    h, w = idx.shape
    if w < 2:
        return edge.copy()
    head = np.zeros((h, w), bool)
    head[:, 0] = True
    head[:, 1 : w - 1] = idx[:, 1 : w - 1] != idx[:, : w - 2]
    start = np.flatnonzero(head)
    row, first = start // w, start % w
    stop = np.append(first[1:], 0)
    last = np.append(row[1:] != row[:-1], True)
    stop[last] = w - 1
    own = idx[row, first]
    inside = np.arange(w)[None, :] < w - 1
    of_run = (np.cumsum(head) - 1).reshape(h, w)
    shared = np.zeros(len(start))
    for other in (-1, 1):
        near = np.zeros((h, w), bool)
        a, b = (slice(1, None), slice(None, -1)) if other == -1 else (slice(None, -1), slice(1, None))
        near[a] = idx[b] == own[of_run][a]
        shared += np.bincount(of_run[near & inside], minlength=len(start))
    factor = 1 - 20 / (20 + 10 * (stop - first) + 15 * shared)

    def scaled(value: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.floor((value + 128) * (255 / 383) * by).astype(np.int64)

    out = edge.astype(np.int64)
    # a run's first pixel has the factor of the run before it first
    twice = start[first > 0]
    out.ravel()[twice] = scaled(out.ravel()[twice], factor[np.flatnonzero(first > 0) - 1])
    # the last pixel belongs to the last run whatever its index
    return scaled(out, factor[of_run])


def diffused(px: DataFrame, palettes: DataFrame, level: float = 1.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """idx of each pixel (internal colour p*, strength 0..255) under Floyd-Steinberg diffusion; even rows run left to right, odd ones back.

    ``palettes`` may hold the error of each image's remap, which bounds the errors that are passed on.

    Where ``px`` has frame_no, its frames are scanned apart with the palette of their image_id. Where it also has what lies
    under a pixel (internal colour u*, null in frames that replace), a pixel may keep it through the transparent entry.
    """
    unit = ["image_id", "frame_no"] if "frame_no" in px.columns else ["image_id"]
    under = [f"u{c}" for c in "argb"] if "ua" in px.columns else []
    own_columns = ["pa", "pr", "pg", "pb", "strength", *under]
    chunk = F.floor(F.col("y") / chunk_rows)
    later = F.when(F.pmod(F.col("y"), F.lit(chunk_rows)) >= chunk_rows - WARM_ROWS, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = px.select(*unit, "y", "x", *own_columns, F.explode(later).alias("chunk"))
    # a chunk's palette meets it once, not in each of its pixels
    extent = px.groupBy(*unit).agg(F.max("y").alias("_last"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / chunk_rows))
    entries = extent.select(*unit, F.explode(numbers).alias("chunk")).join(palettes.select("image_id", "idx", *(f"q{c}" for c in "argb"), *(["error"] if "error" in palettes.columns else [])), "image_id")
    # both sides may come from one table: named anew, their columns stay apart
    entries = entries.select(*(F.col(c).alias(c) for c in entries.columns))

    def run(key: tuple, pdf: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        pdf, listed = pdf.sort_values(["y", "x"]), listed.sort_values("idx")
        first = int(key[-1]) * chunk_rows
        if not len(listed) or not (pdf["y"] >= first).any():
            return pdf.head(0).assign(idx=0)[[*unit, "y", "x", "idx"]]
        palette = listed[["qa", "qr", "qg", "qb"]].to_numpy(float)
        rows, w = pdf["y"].unique(), int(pdf["x"].nunique())
        own = pdf[["pa", "pr", "pg", "pb"]].to_numpy(float).reshape(len(rows), w, 4)
        strength = pdf["strength"].to_numpy(float).reshape(len(rows), w) / 255 * base_level(level)
        below = pdf[under].to_numpy(float).reshape(len(rows), w, 4) if under and pdf["ua"].notna().all() else None
        places = scan(own, strength, palette, int(rows[0]), below, most_error(float(listed["error"].iloc[0]) if "error" in listed else None))
        out = pdf[[*unit, "y", "x"]].assign(idx=listed["idx"].to_numpy()[places.ravel()])
        return out[out["y"] >= first]

    schema = INDEXED.replace("image_id long", "image_id long, frame_no long") if len(unit) == 2 else INDEXED
    return dealt.groupBy(*unit, "chunk").cogroup(entries.groupBy(*unit, "chunk")).applyInPandas(run, schema)


#: Errors of qualities 35 and 80 in internal units.
_Q35, _Q80 = (0.45 * (max(0.016 / (0.001 + q) - 0.001, 0.0) + 2.5 / (210.0 + q) ** 1.2 * (100.1 - q) / 100.0) for q in (35, 80))


def base_level(level: float) -> float:
    """Share of the error that goes on, from the level asked for."""
    return (1 - (1 - level) ** 2) * 15 / 16


def most_error(error: float | None) -> float:
    """Errors beyond this are damped, from the mean error of the image's remap."""
    return max(2.4 * (_Q80 if error is None else error), _Q35)


def scan(own: np.ndarray, strength: np.ndarray, palette: np.ndarray, first_row: int = 0, under: np.ndarray | None = None, cap: float = _Q35) -> np.ndarray:
    """Places in ``palette`` of an (h, w, 4) image by serpentine diffusion; errors beyond ``cap`` are damped.

    With the colours ``under`` it and a transparent entry in the palette, a pixel takes that entry where what lies under is
    as near; where diffusion would do worse than leaving the old colour, it takes the entry that the pixel before it met, if
    that does better, at most twice before the count starts again.
    """
    h, w, _ = own.shape
    out = np.zeros((h, w), np.int64)
    carry = np.zeros((w + 2, 4))
    clear = int((palette**2).sum(1).argmin()) if len(palette) else 0
    if under is not None and palette[clear, 0] >= 0.625 / 255:
        under = None
    for k in range(h):
        plain_used = met = 0
        ahead, step = np.zeros((w + 2, 4)), 1 if (first_row + k) % 2 == 0 else -1
        for x in range(w) if step == 1 else range(w - 1, -1, -1):
            wanted = _pushed(own[k, x], carry[x + 1] * strength[k, x], cap)
            gaps = differences(wanted[None], palette)[0]
            i = int(gaps.argmin())
            shown, before, met = palette[i], met, i
            if under is not None:
                old = under[k, x]
                if differences(wanted[None], old[None])[0, 0] <= gaps[i]:
                    i, shown = clear, old
                elif plain_used > 1:
                    plain_used = 0
                else:
                    change = differences(own[k, x][None], np.vstack([old, shown, palette[before]]))[0]
                    if change[1] > change[0] > change[2]:
                        plain_used += 1
                        i, shown = before, palette[before]
            out[k, x] = i
            error = wanted - shown
            if (error**2).sum() > cap:
                error = error * 0.75
            carry[x + 1 + step] += error * (7 / 16)
            ahead[x + 1 - step] += error * (3 / 16)
            ahead[x + 1] += error * (5 / 16)
            ahead[x + 1 + step] += error * (1 / 16)
        carry = ahead
    return out


def _pushed(colour: np.ndarray, error: np.ndarray, cap: float) -> np.ndarray:
    """The colour with its error: red, green and blue kept near the gamut together, alpha inside it; errors too small to see are ignored, large ones damped."""
    size = float((error**2).sum())
    if size < 2 / 65536:
        return colour
    ratio = 1.0
    for c in (1, 2, 3):
        if colour[c] + error[c] > 1.1 and error[c]:
            ratio = min(ratio, (1.1 - colour[c]) / error[c])
        elif colour[c] + error[c] < -0.1 and error[c]:
            ratio = min(ratio, (-0.1 - colour[c]) / error[c])
    if size > cap:
        ratio *= 0.8
    out = colour + error * ratio
    out[0] = min(max(colour[0] + error[0], 0.0), 1.0)
    return out
