"""Invariants of the operators that no SQL expresses, and literal animations."""

import numpy as np
from pyspark.sql import functions as F

from chromaflow.operators import dither, frames, histogram, palette, remap
from chromaflow.plans import catalogue, quantize
from chromaflow.plans.views import pixels, with_internal
from chromaflow.sources import png


def test_median_cut_and_search():
    rng = np.random.default_rng(0)
    items, weight = rng.random((64, 4)) * 0.6, rng.random(64) + 0.1
    cut, popularity = palette.median_cut(items, weight, 4)
    assert len(cut) <= 4 and abs(popularity.sum() - weight.sum()) < 1e-9
    before = (palette.nearest(items, cut)[1] * weight).sum() / weight.sum()
    _, _, after = palette.kmeans(items, weight, cut, 12, 0.0)
    assert after <= before + 1e-12
    exact, _, error = palette.best_palette(items, weight, palette.Search(colours=64))
    assert error == 0 and (exact == items).all()


def test_nearest_is_brute_force(spark, sf_dir):
    px = with_internal(pixels(spark, sf_dir).filter("image_id = 0 and y < 3"))
    own = catalogue.palette_of(pixels(spark, sf_dir).filter("image_id = 0"))
    got = remap.nearest(px, own).toPandas()
    entries = own.orderBy("idx").toPandas()
    idx, _ = palette.nearest(got[["pa", "pr", "pg", "pb"]].to_numpy(), entries[["qa", "qr", "qg", "qb"]].to_numpy())
    assert (got["idx"].to_numpy() == idx).all()


def test_dither_chunks_agree_on_size_and_range(spark, sf_dir):
    px = with_internal(pixels(spark, sf_dir).filter("image_id < 2")).withColumn("strength", F.lit(255))
    own = catalogue.palette_of(pixels(spark, sf_dir).filter("image_id < 2"))
    whole, cut = (dither.diffused(px, own, chunk_rows=n).toPandas() for n in (1000, 8))
    assert len(whole) == len(cut) == px.count() and not cut.duplicated(["image_id", "y", "x"]).any()
    assert whole["idx"].between(0, 15).all() and cut["idx"].between(0, 15).all()
    flat = np.tile(np.array([0.625, 0.2, 0.4, 0.1]), (4, 6, 1))
    assert (dither.scan(flat, np.ones((4, 6)), flat[0, :1]) == 0).all()


def test_composition(spark):
    """A row of two: half green over red restored by the next frame, then green on the right."""
    canvas = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "anim string, y long, x long")
    fr = spark.createDataFrame([("a", 0, 2, 1, 0, 0, "none", "source"), ("a", 1, 1, 1, 0, 0, "previous", "over"), ("a", 2, 1, 1, 1, 0, "none", "over")], "anim string, frame_no long, w long, h long, x_off long, y_off long, dispose string, blend string")
    drawn = spark.createDataFrame([("a", 0, 0, 0, 255, 0, 0, 255), ("a", 0, 0, 1, 255, 0, 0, 255), ("a", 1, 0, 0, 0, 255, 0, 128), ("a", 2, 0, 0, 0, 255, 0, 255)], "anim string, frame_no long, y long, x long, r long, g long, b long, a long")
    got = {(r.frame_no, r.x): (r.r, r.g, r.b, r.a) for r in frames.composed(canvas, fr, drawn).collect()}
    assert got == {(0, 0): (255, 0, 0, 255), (0, 1): (255, 0, 0, 255), (1, 0): (127, 128, 0, 255), (1, 1): (255, 0, 0, 255), (2, 0): (255, 0, 0, 255), (2, 1): (0, 255, 0, 255)}
    out = frames.composed(canvas, fr, drawn)
    assert frames.same_composites(out, out).first()["same"]


def test_histogram_merge(spark):
    px = spark.createDataFrame([(0, 0, 0, 255, 0, 0, 255), (0, 0, 1, 0, 255, 0, 255), (1, 0, 0, 255, 0, 0, 255), (1, 0, 1, 0, 0, 255, 255)], "image_id long, y long, x long, r long, g long, b long, a long")
    got = {r.key: r.importance for r in histogram.merged(histogram.colour_histogram(px)).collect()}
    assert sorted(got.values()) == [255, 255, 510]


def test_quantize_end_to_end(spark, sf_dir):
    px = pixels(spark, sf_dir).filter("image_id < 2")
    got = quantize.quantize(px, quantize.Options(speed=10, max_colours=8, min_quality=0, dither=0.0)).toPandas()
    assert (got["colours"] <= 8).all() and (got["status"] == "ok").all() and got["score"].between(0, 100).all()
    strict = quantize.quantize(px, quantize.Options(speed=10, max_colours=2, min_quality=99, max_quality=100, dither=0.0)).toPandas()
    assert (strict["exit_code"] == 98).all()


def test_quantize_follows_its_speed(spark, sf_dir):
    """At the default speed the maps weigh the histogram, entries are used and ordered, and the file holds what was scored."""
    assert quantize.Options().contrast and not quantize.Options(speed=8).contrast
    px = pixels(spark, sf_dir).filter("image_id < 1")
    got = quantize.quantize(px, quantize.Options(max_colours=12)).toPandas().iloc[0]
    back = png.decode(bytes(got["content"]))
    colours, counts = np.unique(back.still.reshape(-1, 4), axis=0, return_counts=True)
    assert back.is_indexed and got["colours"] == len(colours) <= 12 and got["score"] > 0
    plte = dict(png.chunks(bytes(got["content"])))[b"PLTE"]
    shown = [tuple(plte[k : k + 3]) for k in range(0, len(plte), 3)]
    assert len(shown) == len(colours)
    n = {tuple(c[:3].tolist()): (c[3] < 255, k) for c, k in zip(colours, counts.tolist())}
    assert [n[c] for c in shown] == sorted((n[c] for c in shown), reverse=True)
    maps = quantize.with_maps(px, quantize.Options())
    assert maps.select("noise").distinct().count() > 1 and maps.select("edge").distinct().count() > 1
    plain = maps.withColumn("idx", F.lit(0).cast("long"))
    ours = quantize.strengths(plain, quantize.Options()).agg(F.sum("strength")).first()[0]
    assert ours < dither.dither_map(plain.withColumn("edge", F.lit(255))).agg(F.sum("strength")).first()[0]
    assert {r.strength for r in quantize.strengths(plain, quantize.Options(speed=7)).collect()} == {255}


def test_search_budgets():
    """Large histograms back off, and no error finer than the output's bits is asked for."""
    own = palette.Search(trials=20, iterations=12).for_items(30_000)
    assert (own.trials, own.iterations) == (12, 7) and own.target_error == 2.0**-20


def test_trials_lower_the_error():
    rng = np.random.default_rng(1)
    items, weight = rng.random((1500, 4)) * 0.6, rng.random(1500) + 0.1
    once = palette.best_palette(items, weight, palette.Search(colours=32, trials=0, iterations=0))[2]
    tried = palette.best_palette(items, weight, palette.Search(colours=32, trials=20, iterations=0))[2]
    assert tried < once and palette.best_palette(items, weight, palette.Search.of_speed(4, 32))[2] < tried


def test_registered_searches_are_whole(spark, sf_dir):
    """The registered search has the colours, bits and trials of the default speed: as good as the search on unmasked pixels."""
    got = catalogue.QUERIES["find_best_palette"](spark, sf_dir).filter("image_id = 0").toPandas()
    items = with_internal(histogram.finalized(histogram.colour_histogram(pixels(spark, sf_dir).filter("image_id = 0")))).toPandas().sort_values(["pa", "pr", "pg", "pb"])
    items, weight = items[["pa", "pr", "pg", "pb"]].to_numpy(), items["weight"].to_numpy()
    assert len(items) > 256 >= len(got) > 200
    want = palette.best_palette(items, weight, palette.Search.of_speed(4))[2]
    assert abs(got["error"].iloc[0] - want) < 1e-12
    assert want < palette.best_palette(items, weight, palette.Search.of_speed(8))[2]
    images = catalogue.QUERIES["quantize_images"](spark, sf_dir).toPandas()
    assert (images["colours"] > 200).all() and (images["score"] > 2).all()
