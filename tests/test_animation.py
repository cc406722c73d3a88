"""Animations against a plain numpy version: composing, folding, minimising with rollback, trimming, quantising."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaflow.operators import animation, dither, frames
from chromaflow.plans import animate, quantize
from chromaflow.sources import png

SIZES = "anim long, width long, height long"
FRAMES = "anim long, frame_no long, w long, h long, x_off long, y_off long, delay_num long, delay_den long, dispose string, blend string"
DRAWN = "anim long, frame_no long, y long, x long, r long, g long, b long, a long"


def relations(spark, animations):
    """Lists of png.Png by anim as the three relations."""
    sizes = [(k, p.width, p.height) for k, p in animations.items()]
    fr = [(k, n, f.rgba.shape[1], f.rgba.shape[0], f.x_off, f.y_off, f.delay_num, f.delay_den, f.dispose, f.blend) for k, p in animations.items() for n, f in enumerate(p.frames)]
    px = [(k, n, y, x, *map(int, f.rgba[y, x])) for k, p in animations.items() for n, f in enumerate(p.frames) for y in range(f.rgba.shape[0]) for x in range(f.rgba.shape[1])]
    return tuple(spark.createDataFrame(rows, schema) for rows, schema in ((sizes, SIZES), (fr, FRAMES), (px, DRAWN)))


def back(sizes, fr, drawn):
    """The relations as png.Png by anim."""
    px = {k: g for k, g in drawn.toPandas().groupby(["anim", "frame_no"])}
    out = {s["anim"]: png.Png(s["width"], s["height"], None) for s in sizes.collect()}
    for f in fr.orderBy("anim", "frame_no").collect():
        g = px[(f["anim"], f["frame_no"])].sort_values(["y", "x"])
        rgba = g[list("rgba")].to_numpy().reshape(f["h"], f["w"], 4)
        out[f["anim"]].frames.append(png.Frame(rgba, f["x_off"], f["y_off"], f["delay_num"], f["delay_den"], f["dispose"], f["blend"]))
    return out


def shown(p):
    """Canvases of an animation after each frame."""
    canvas, out = np.zeros((p.height, p.width, 4), int), []
    undo = None
    for k, f in enumerate(p.frames):
        if undo is not None:
            canvas = undo
        h, w = f.rgba.shape[:2]
        region = (slice(f.y_off, f.y_off + h), slice(f.x_off, f.x_off + w))
        dispose = "background" if k == 0 and f.dispose == "previous" else f.dispose
        before = canvas.copy()
        now = canvas.copy()
        s, d = f.rgba.astype(float), before[region].astype(float)
        if f.blend == "over":
            sa, da = s[..., 3:] / 255, d[..., 3:] / 255
            oa = sa + da * (1 - sa)
            rgb = np.floor((s[..., :3] * sa + d[..., :3] * da * (1 - sa)) / np.where(oa > 0, oa, 1) + 0.5)
            now[region] = np.where(oa > 0, np.concatenate([rgb, np.floor(oa * 255 + 0.5)], 2), 0)
        else:
            now[region] = f.rgba
        out.append(now.copy())
        undo = None
        if dispose == "previous":
            undo = before
        elif dispose == "background":
            undo = now.copy()
            undo[region] = 0
        canvas = now
    return out


def random_animations(n=6, colours=2):
    rng = np.random.default_rng(5)
    palette = np.array([[255, 0, 0, 255], [0, 255, 0, 128], [0, 0, 0, 0], [9, 9, 200, 255]])[: colours + 1]
    made = {}
    for k in range(n):
        w, h = (int(v) for v in rng.integers(2, 5, 2))
        p = png.Png(w, h, None)
        for i in range(5):
            fw, fh = (w, h) if i == 0 else (int(rng.integers(1, w + 1)), int(rng.integers(1, h + 1)))
            x, y = int(rng.integers(0, w - fw + 1)), int(rng.integers(0, h - fh + 1))
            rgba = palette[rng.integers(0, len(palette), (fh, fw))] if rng.random() < 0.7 else np.full((fh, fw, 4), palette[0])
            p.frames.append(png.Frame(rgba, x, y, int(rng.integers(0, 9)), int(rng.choice([0, 10, 25])), str(rng.choice(png.DISPOSE)), str(rng.choice(png.BLEND))))
        made[k] = p
    still = np.full((2, 2, 4), 255)
    made[100] = png.Png(2, 2, None, [png.Frame(still, delay_num=1, delay_den=10), png.Frame(still, delay_num=2, delay_den=10), png.Frame(np.zeros((2, 2, 4), int), delay_num=3, delay_den=10)])
    made[101] = png.Png(2, 2, None, [png.Frame(still, dispose="background"), png.Frame(np.full((1, 1, 4), 9))])
    return made


@pytest.fixture(scope="module")
def made(spark):
    own = random_animations()
    return own, relations(spark, own)


def test_composites(made):
    own, (sizes, fr, drawn) = made
    got = frames.composed(frames.canvas_cells(sizes), fr, drawn).toPandas()
    for k, p in own.items():
        for n, canvas in enumerate(shown(p)):
            g = got[(got.anim == k) & (got.frame_no == n)].sort_values(["y", "x"])
            assert (g[list("rgba")].to_numpy().reshape(canvas.shape) == canvas).all()


def test_fold(made):
    own, rel = made
    got = back(rel[0], *animation.folded_frames(*rel))
    for k, p in own.items():
        seen = shown(p)
        heads = [n for n in range(len(seen)) if n == 0 or (seen[n] != seen[n - 1]).any()]
        assert [f.rgba.tolist() for f in got[k].frames] == [p.frames[n].rgba.tolist() for n in heads]
    assert [(f.delay_num, f.delay_den) for f in got[100].frames] == [(3, 10), (3, 10)]


def test_minimise_keeps_composites_or_rolls_back(made):
    own, rel = made
    got = back(rel[0], *animation.checked_minimised_frames(*rel))
    for k, p in own.items():
        assert all((a == b).all() for a, b in zip(shown(p), shown(got[k]), strict=True))
    assert [f.rgba.shape[:2] for f in got[101].frames] == [(2, 2), (2, 2)]  # what the disposal clears is in the box
    assert [f.rgba.shape[:2] for f in got[100].frames] == [(2, 2)] * 3  # the blank pixel of a frame without change would show: rolled back


def test_trim(spark):
    full = np.zeros((3, 4, 4), int)
    full[:2, :3] = 255
    own = {0: png.Png(4, 3, None, [png.Frame(full), png.Frame(full, blend="over"), png.Frame(np.zeros((3, 4, 4), int))])}
    got = back(*(lambda r: (r[0], *animation.trimmed_frames(*r)))(relations(spark, own)))[0].frames
    assert [f.rgba.shape[:2] for f in got] == [(2, 3), (3, 4), (3, 4)]


@pytest.mark.parametrize(("mode", "dither_"), [("safe", 0.0), ("aggressive", 0.0), ("safe", 1.0)])
def test_quantize(made, mode, dither_):
    """Few colours: the file shows what the animation shows, frame by frame, or nearly so where alpha is rounded."""
    own, rel = made
    got = animate.quantize_animations(*rel, quantize.Options(speed=10, max_colours=16, dither=dither_, max_quality=100), mode).collect()
    assert {r["anim"] for r in got} == set(own)
    for r in got:
        p = png.decode(bytes(r["content"]))
        assert r["status"] == "ok" and r["colours"] <= 16 and r["size_bytes"] == len(r["content"]) and len(p.frames) == r["frames"]
        seen = shown(own[r["anim"]])
        want = [c for n, c in enumerate(seen) if n == 0 or (c != seen[n - 1]).any()]
        if dither_ == 0 and r["anim"] >= 100:
            assert len(want) == r["frames"] and all(np.abs(a - b).max() <= 8 for a, b in zip(shown(p), want, strict=True))


def test_background_scan():
    """What lies under and equals a pixel is kept through the transparent entry."""
    palette = np.array([[0.0, 0, 0, 0], [0.625, 0.5, 0, 0], [0.625, 0, 1.0, 0]])
    own = np.tile(palette[1], (2, 3, 1))
    under = own.copy()
    under[0, 1] = palette[2]
    got = dither.scan(own, np.ones((2, 3)), palette, 0, under)
    assert got.tolist() == [[0, 1, 0], [0, 0, 0]]
    assert (dither.scan(own, np.ones((2, 3)), palette[1:], 0, under) == 0).all()


def test_mismatches(made):
    _, (sizes, fr, drawn) = made
    one = frames.composed(frames.canvas_cells(sizes), fr, drawn)
    assert frames.mismatches(one, one).isEmpty()
    other = one.withColumn("r", F.when((F.col("anim") == 100) & (F.col("frame_no") == 1), 3).otherwise(F.col("r")))
    got = frames.mismatches(one, other, 2).collect()
    assert [(r["anim"], r["frame_no"], r["differing"], len(r["cells"])) for r in got] == [(100, 1, 4, 2)]
