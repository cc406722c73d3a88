"""Levels against a per-pixel loop; colour profiles against known colours."""

import struct

import numpy as np
from pyspark.sql import functions as F

from chromaflow.functions import profile
from chromaflow.operators import levels, report


def test_levels(spark):
    got = spark.createDataFrame([(0, 1), (100, 1), (50, 4), (0, 11), (90, 2)], "q long, s long").select(levels.levels_of(F.col("q"), F.col("s"))).collect()
    assert [r[0] for r in got] == [2, 32, 15, 2, 29]


def test_diffusion(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(0, 256, (6, 5, 4))
    rows = [(0, y, x, *map(int, own[y, x])) for y in range(6) for x in range(5)]
    px = spark.createDataFrame(rows, levels.PIXEL)
    got = levels.levelled_diffused(px, 4).toPandas().sort_values(["y", "x"])
    assert set(np.unique(got[list("rgba")])) <= {0, 85, 170, 255}
    want, spread = np.zeros((6, 5, 3)), np.zeros((7, 7, 3))
    for y in range(6):
        for x in range(5):
            v = own[y, x, :3] + spread[y, x + 1]
            want[y, x] = np.floor(np.floor(np.clip(v, 0, 255) / 255 * 3 + 0.5) / 3 * 255 + 0.5)
            for dy, dx, part in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                spread[y + dy, x + 1 + dx] += (v - want[y, x]) * part / 16
    assert (got[list("rgb")].to_numpy().reshape(6, 5, 3) == want).all()


def meta(gamma, chroma, *more):
    kinds = [("gAMA", struct.pack(">I", round(gamma * 100000))), ("cHRM", struct.pack(">8I", *(round(c * 100000) for c in chroma))), *more]
    return [{"kind": k, "body": b} for k, b in kinds]


def test_profiles(spark):
    wide = (0.3127, 0.3290, 0.64, 0.33, 0.21, 0.71, 0.15, 0.06)
    files = [("srgb", meta(0.45455, profile.SRGB)), ("wide", meta(0.45455, wide)), ("said", meta(0.45455, wide, ("sRGB", b"\0"))), ("none", []), ("odd", meta(0.0, wide))]
    info = spark.createDataFrame(files, "path string, metadata array<struct<kind:string,body:binary>>")
    px = info.select("path").crossJoin(spark.createDataFrame([(255, 255, 255, 7), (0, 0, 0, 9), (200, 60, 60, 255)], "r long, g long, b long, a long"))
    got = {}
    for r in profile.normalised(px, info).collect():
        got.setdefault(r["path"], {})[r["a"]] = (r["r"], r["g"], r["b"])
    assert all(g[7] == (255, 255, 255) and g[9] == (0, 0, 0) for g in got.values())
    assert all(got[k][255] == (200, 60, 60) for k in ("said", "none", "odd"))
    # same primaries: each channel is decoded by the power 1 / 0.45455 and encoded by the sRGB curve
    assert got["srgb"][255] == tuple(int(np.floor((1.055 * (v / 255) ** (1 / 0.45455 / 2.4) - 0.055) * 255 + 0.5)) for v in (200, 60, 60)) == (201, 57, 57)
    assert got["wide"][255][0] > 205


def test_suites_and_stability(spark):
    got = report.suites(spark.createDataFrame([("a", True), ("b", False)], "suite string, passed boolean")).first()
    assert (got["suites"], got["failed"], got["passed"]) == (2, 1, False)
    none = spark.createDataFrame([], "expected_success boolean, exit_code long, stderr string, signalled boolean")
    assert report.stability(none).first().asDict() == {"cases": 0, "crash_like": 0, "failures": 0, "passed": True}
