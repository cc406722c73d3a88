"""Colours of images that state a gamma and chromaticities, brought to sRGB.

White points are adapted to D50 on both sides, then the linear colours go through one
matrix. Stated sRGB wins over gamma and chromaticities; images that state neither, or a
gamma outside (0, 1], are as they are. Embedded ICC profiles are left as they are: no
colour management library is at hand.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Bradford cone responses, the D50 white, and the primaries and white of sRGB.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
D50 = (0.9642, 1.0, 0.8249)
SRGB = (0.3127, 0.3290, 0.64, 0.33, 0.30, 0.60, 0.15, 0.06)


def to_d50(chroma) -> np.ndarray:
    """Matrix from linear colour to XYZ under D50 of (white x, y, red x, y, green x, y, blue x, y)."""
    xy = np.asarray(chroma, float).reshape(4, 2)
    xyz = np.column_stack([xy[:, 0] / xy[:, 1], np.ones(4), (1 - xy.sum(1)) / xy[:, 1]])
    white, primaries = xyz[0], xyz[1:].T
    own = primaries * np.linalg.solve(primaries, white)
    cone = np.array(BRADFORD)
    gain = (cone @ np.array(D50)) / (cone @ white)
    return np.linalg.solve(cone, gain[:, None] * cone) @ own


def to_srgb(chroma) -> np.ndarray | None:
    """Matrix from linear colour to linear sRGB; None where the chromaticities span no colours."""
    try:
        matrix = np.linalg.solve(to_d50(SRGB), to_d50(chroma))
    except (np.linalg.LinAlgError, ZeroDivisionError):
        return None
    return matrix if np.isfinite(matrix).all() else None


def transform_of(metadata) -> list[float] | None:
    """[gamma, nine entries row by row] from a file's (kind, body) chunks; None if its colours stay as they are."""
    found = {m["kind"]: bytes(m["body"]) for m in (metadata if metadata is not None else [])}
    if "iCCP" in found or "sRGB" in found or "gAMA" not in found or "cHRM" not in found:
        return None
    gamma = struct.unpack(">I", found["gAMA"][:4])[0] / 100000
    chroma = np.array(struct.unpack(">8I", found["cHRM"][:32])) / 100000
    if not 0 < gamma <= 1 or (chroma[1::2] <= 0).any():
        return None
    matrix = to_srgb(chroma)
    return None if matrix is None else [gamma, *matrix.ravel().tolist()]


def transforms(info: DataFrame) -> DataFrame:
    """path and transform of each image of ``info`` (path, metadata)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "transform": [transform_of(m) for m in pdf["metadata"]]})

    return info.select("path", "metadata").mapInPandas(run, "path string, transform array<double>")


def kept(metadata) -> list[dict]:
    """A file's (kind, body) chunks as they hold for its pixels in sRGB: colours that were converted are stated as sRGB."""
    rows = [{"kind": m["kind"], "body": bytes(m["body"])} for m in (metadata if metadata is not None else [])]
    if transform_of(rows) is None:
        return rows
    return [m for m in rows if m["kind"] not in ("gAMA", "cHRM", "iCCP", "sRGB")] + [{"kind": "sRGB", "body": b"\0"}]


def kept_metadata(info: DataFrame) -> DataFrame:
    """path and the metadata to write of each image of ``info`` (path, metadata)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "metadata": [kept(m) for m in pdf["metadata"]]})

    return info.select("path", "metadata").mapInPandas(run, "path string, metadata array<struct<kind:string,body:binary>>")


def normalised(px: DataFrame, info: DataFrame) -> DataFrame:
    """``px`` (path, ..., r, g, b, a) with its colours in sRGB where its image states others."""
    t = F.col("_transform")
    linear = [F.pow(F.col(c) / 255.0, 1.0 / F.element_at(t, 1)) for c in "rgb"]

    def channel(k: int) -> Column:
        v = sum((F.element_at(t, 2 + 3 * k + j) * linear[j] for j in range(1, 3)), F.element_at(t, 2 + 3 * k) * linear[0])
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        curve = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
        return F.floor(curve * 255.0 + 0.5).cast("long")

    found = px.join(transforms(info).withColumnRenamed("transform", "_transform"), "path", "left")
    shown = {c: F.when(t.isNull(), F.col(c).cast("long")).otherwise(channel(k)) for k, c in enumerate("rgb")}
    return found.withColumns(shown).select(*px.columns)
