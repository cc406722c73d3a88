"""All queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import animation, dither, frames, histogram, levels, palette, remap, report, stencil
from ..sources import png
from .views import PX, pixels, sql_difference, sql_internal, sql_mse_of, table, with_internal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BITS = 5
P_ALL = "cast({0} as bigint) as {0}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(*names: str) -> str:
    return ", ".join(P_ALL.format(n) for n in names)


def sql_key(c: str = "{}") -> str:
    r, g, b, a = (c.format(k) for k in "rgba")
    return f"(case when {a} = 0 then 0 else {r} + {g} * 256 + {b} * 65536 + {a} * 16777216 end)"


def sql_cluster(c: str = "{}") -> str:
    return "(" + " + ".join(f"({c.format(k)} >> 7) * {w}" for k, w in zip("rgba", (8, 4, 2, 1))) + ")"


MASKED = ", ".join(f"{k} & {255 & ~((1 << BITS) - 1)} as {k}" for k in "rgba")
HIST = f"""{PX},
pm as (select image_id, y, x, {MASKED} from px),
hist as (select image_id, {sql_key()} as key, least(sum(255), 4294967295) as importance, arg_min(r, y * 1000000 + x) as r, arg_min(g, y * 1000000 + x) as g,
 arg_min(b, y * 1000000 + x) as b, arg_min(a, y * 1000000 + x) as a from pm group by image_id, {sql_key()})"""


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.colour_histogram(pixels(spark, sf_dir), BITS)


@query(f"with {HIST} select {longs('image_id', 'key', 'importance', 'r', 'g', 'b', 'a')}, cast({sql_cluster()} as bigint) as cluster from hist")
def histogram_posterized(spark, sf_dir):
    return hist(spark, sf_dir)


COARSE = {k: f"({k} & 128)" for k in "rgba"}
_coarse = f"(case when {COARSE['a']} = 0 then 0 else {COARSE['r']} + {COARSE['g']} * 256 + {COARSE['b']} * 65536 + {COARSE['a']} * 16777216 end)"


@query(f"with {HIST} select {longs('image_id')}, cast({_coarse} as bigint) as coarse, cast(arg_max(importance, key) as bigint) as importance, cast(least(sum(importance), 4294967295) as bigint) as summed from hist group by image_id, {_coarse}")
def histogram_overwrite_rekey(spark, sf_dir):
    return histogram.rekeyed(hist(spark, sf_dir), 7)


@query(f"with {HIST} select {longs('key')}, cast(least(sum(importance), 4294967295) as bigint) as importance, count(*) as frames from hist group by key")
def histogram_merge_frames(spark, sf_dir):
    return histogram.merged(hist(spark, sf_dir))


WEIGHTED = f"{HIST}, weighted as (select *, least(importance / 255.0::double, 0.1::double * (sum(importance) over (partition by image_id)) / 255.0::double) as weight from hist where importance > 0)"


@query(f"with {WEIGHTED} select {longs('image_id', 'key')}, round(weight, 9) as weight from weighted")
def histogram_finalize_weights(spark, sf_dir):
    return histogram.finalized(hist(spark, sf_dir)).select("image_id", "key", F.round("weight", 9).alias("weight"))


@query(f"""with {WEIGHTED} select {longs('image_id')}, count(*) as entries, round(sum(w), 6) as weight, cast(sum(added) as bigint) as added from (
 select image_id, weight as w, 0 as added from weighted union all
 select image_id, greatest(0.1::double * avg(weight), 1e-6::double), 1 from weighted group by image_id having count(*) filter (a = 0) = 0) group by image_id""")
def transparent_injection(spark, sf_dir):
    items = histogram.with_transparent(histogram.finalized(hist(spark, sf_dir)))
    before = hist(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"))
    got = items.groupBy("image_id").agg(F.count("*").alias("entries"), F.round(F.sum("weight"), 6).alias("weight"))
    return got.join(before, "image_id").select("image_id", "entries", "weight", (F.col("entries") - F.col("n")).alias("added"))


@query(f"with {HIST} select {longs('image_id')}, cast({sql_cluster()} as bigint) as cluster, count(*) as entries, cast(sum(importance) as bigint) as importance from hist group by image_id, {sql_cluster()}")
def cluster_counts(spark, sf_dir):
    return histogram.cluster_counts(hist(spark, sf_dir))


INTERNAL = f"{PX}, pi as ({sql_internal('px')})"
_rounded = ", ".join(f"round(p{c}, 9) as p{c}" for c in "argb")


@query(f"with {INTERNAL} select {longs('image_id', 'y', 'x')}, {_rounded} from pi")
def internal_pixel(spark, sf_dir):
    return with_internal(pixels(spark, sf_dir)).select("image_id", "y", "x", *(F.round(f"p{c}", 9).alias(f"p{c}") for c in "argb"))


def _back(v: str, w: str) -> str:
    return f"cast(case when pa <= 0.625::double / 255 then 0 else floor(least(greatest(pow(greatest(p{v} / {w}::double / (pa / 0.625::double), 0), {E.GAMMA_OUT / E.GAMMA_IN!r}) * 256 + 1e-6, 0), 255)) end as bigint) as {v}"


@query(f"with {INTERNAL} select {longs('image_id', 'y', 'x')}, {_back('r', '0.5')}, {_back('g', '1.0')}, {_back('b', '0.45')} from pi")
def internal_round_trip(spark, sf_dir):
    px = with_internal(pixels(spark, sf_dir))
    nudged = px.select("image_id", "y", "x", "pa", *(F.col(f"p{c}") for c in "rgb"))
    clear = F.col("pa") <= 0.625 / 255
    back = lambda c, w: F.when(clear, F.lit(0).cast("long")).otherwise(E.to_byte(F.pow(F.greatest(F.col(f"p{c}") / w / (F.col("pa") / 0.625), F.lit(0.0)), F.lit(E.GAMMA_OUT / E.GAMMA_IN)) * 256.0 + 1e-6))
    return nudged.select("image_id", "y", "x", back("r", 0.5).alias("r"), back("g", 1.0).alias("g"), back("b", 0.45).alias("b"))


MEANS = f"{INTERNAL}, m as (select image_id, " + ", ".join(f"cast(floor(avg({c})) as bigint) as {c}" for c in "rgba") + f" from px group by image_id), mi as ({sql_internal('m', 'o', 'image_id')})"
MSE = f"{MEANS}, mse as (select pi.image_id, avg({sql_difference('pi.p', 'mi.o')}) as mse from pi join mi using (image_id) group by pi.image_id)"


def _against_mean(spark, sf_dir):
    px = pixels(spark, sf_dir)
    mean = px.groupBy("image_id").agg(*(F.floor(F.avg(c)).cast("long").alias(c) for c in "rgba"))
    other = with_internal(mean, "o").select("image_id", *(f"o{c}" for c in "argb"))
    return with_internal(px).join(other, "image_id")


@query(f"with {MSE} select {longs('image_id')}, round(mse, 9) as mse, round(mse * 65536.0::double / 6.0::double / 0.45::double, 5) as standard_mse from mse")
def color_diff_mse(spark, sf_dir):
    return remap.quality(_against_mean(spark, sf_dir)).select("image_id", F.round("mse", 9).alias("mse"), F.round("standard_mse", 5).alias("standard_mse"))


@query(f"with {MSE}, q as (select unnest(range(1, 101)) as q), s as (select image_id, mse / 100 as m from mse) select {longs('image_id')}, cast(coalesce(max(q) filter (m <= {sql_mse_of('q')} + 1e-6::double), 0) as bigint) as score from s, q group by image_id")
def quality_from_mse(spark, sf_dir):
    got = remap.quality(_against_mean(spark, sf_dir))
    return got.select("image_id", E.mse_to_quality(F.col("mse") / 100).alias("score"))


@query("""with g as (select o_orderkey, cast(floor(o_totalprice) as bigint) as in_bytes, o_orderkey % 101 as quality, cast(floor(o_totalprice * (o_custkey % 100) / 100) as bigint) as out_bytes from orders)
select o_orderkey, cast(floor(greatest(in_bytes - 1, 0) * greatest(pow(quality / 100.0::double, 1.5::double), 0.5::double) + 1e-6) as bigint) as most_bytes,
 case when quality < 30 then 'quality_too_low' when out_bytes > cast(floor(greatest(in_bytes - 1, 0) * greatest(pow(quality / 100.0::double, 1.5::double), 0.5::double) + 1e-6) as bigint) then 'output_too_large' else 'ok' end as status,
 cast(case when quality < 30 then 98 when out_bytes > cast(floor(greatest(in_bytes - 1, 0) * greatest(pow(quality / 100.0::double, 1.5::double), 0.5::double) + 1e-6) as bigint) then 99 else 0 end as bigint) as exit_code from g""")
def size_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = o.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("in_bytes"), (F.col("o_orderkey") % 101).alias("score"), F.lit(30).alias("min_score"), F.floor(F.col("o_totalprice") * (F.col("o_custkey") % 100) / 100).cast("long").alias("out_bytes"))
    return remap.gated(got).select("o_orderkey", E.most_bytes(F.col("in_bytes"), F.col("score")).alias("most_bytes"), "status", "exit_code")


_i = "greatest(8 - least(speed, 10), 0)"


@query(f"""with s as (select cast(unnest(range(1, 12)) as bigint) as speed) select speed, least(speed, 10) as effective, cast({_i} + floor({_i} * {_i} / 2.0) as bigint) as iterations,
 pow(2.0::double, -(23 - least(speed, 10))) as "limit", greatest(56 - 9 * least(speed, 10), 0) as trials, cast(131072 + 262144 * (10 - least(speed, 10)) as bigint) as max_entries,
 cast(case when least(speed, 10) >= 8 then 1 else 0 end as bigint) as posterize, case when least(speed, 10) < 3 then 'always' when least(speed, 10) <= 6 then 'enabled' else 'none' end as dither_map,
 least(speed, 10) <= 7 as contrast, speed >= 11 as dither_off from s""")
def speed_settings(spark, sf_dir):
    s = F.least(F.col("speed"), F.lit(10))
    return spark.range(1, 12).withColumnRenamed("id", "speed").select(
        "speed", s.alias("effective"), E.iterations_of_speed(F.col("speed")).alias("iterations"), F.pow(F.lit(2.0), -(23 - s).cast("double")).alias("limit"),
        F.greatest(56 - 9 * s, F.lit(0)).alias("trials"), (131072 + 262144 * (10 - s)).alias("max_entries"), F.when(s >= 8, 1).otherwise(0).cast("long").alias("posterize"),
        F.when(s < 3, "always").when(s <= 6, "enabled").otherwise("none").alias("dither_map"), (s <= 7).alias("contrast"), (F.col("speed") >= 11).alias("dither_off"),
    )


@query("""with b as (select cast(unnest(range(0, 130000, 1000)) as bigint) as items),
c as (select items, 20 as n from b), d as (select items, case when items > 5000 then ceil(n * 3 / 4.0) else n end as n from c), e as (select items, case when items > 25000 then ceil(n * 3 / 4.0) else n end as n from d),
f as (select items, case when items > 50000 then ceil(n * 3 / 4.0) else n end as n from e)
select items, cast(case when items > 100000 then ceil(n * 3 / 4.0) else n end as bigint) as trials, round(least(greatest(case when items <= 256 then least(0.004::double, 0.009::double * 0.33::double) else 0.004::double end, pow(4 / 1024.0::double, 2)), 0.009::double), 9) as target from f""")
def budget_back_off(spark, sf_dir):
    items = spark.range(0, 130000, 1000).withColumnRenamed("id", "items")
    target = E.effective_target(F.lit(0.004), F.lit(0.009), F.col("items"), F.lit(256), 2)
    return items.select("items", E.backed_off(F.lit(20), F.col("items")).alias("trials"), F.round(target, 9).alias("target"))


def palette_of(px: DataFrame) -> DataFrame:
    """The colours of each image's first row as a palette."""
    return with_internal(px.filter("y = 0"), "q").select("image_id", F.col("x").alias("idx"), *"rgba", *(f"q{c}" for c in "argb"))


def indexed(spark, sf_dir) -> DataFrame:
    px = pixels(spark, sf_dir)
    return remap.nearest(with_internal(px), palette_of(px), 9)


NEAREST = f"""{INTERNAL}, pal as (select image_id, x as idx, r, g, b, a, {', '.join(f'p{c} as q{c}' for c in 'argb')} from pi where y = 0),
cand as (select pi.image_id, pi.y, pi.x, pi.pa, pi.pr, pi.pg, pi.pb, pal.idx, round({sql_difference('pi.p', 'pal.q')}, 9) as err from pi join pal using (image_id)),
near as (select * from cand qualify row_number() over (partition by image_id, y, x order by err, idx) = 1)"""


@query(f"with {NEAREST} select {longs('image_id', 'y', 'x', 'idx')}, err from near")
def nearest_palette(spark, sf_dir):
    return indexed(spark, sf_dir).select("image_id", "y", "x", "idx", "err")


@query(f"with {NEAREST} select cast(near.image_id as bigint) as image_id, cast(y as bigint) as y, cast(x as bigint) as x, pal.r as out_r, pal.g as out_g, pal.b as out_b, pal.a as out_a from near join pal using (image_id, idx)")
def palette_lookup(spark, sf_dir):
    return remap.looked_up(indexed(spark, sf_dir), palette_of(pixels(spark, sf_dir))).select("image_id", "y", "x", "out_r", "out_g", "out_b", "out_a")


@query(f"with {NEAREST} select {longs('image_id', 'idx')}, count(*) as n, " + ", ".join(f"round(avg(p{c}), 7) as m{c}" for c in "argb") + ", round(avg(err), 7) as mean_err from near group by image_id, idx")
def remap_feedback_means(spark, sf_dir):
    got = remap.feedback(indexed(spark, sf_dir))
    return got.select("image_id", "idx", "n", *(F.round(f"m{c}", 7).alias(f"m{c}") for c in "argb"), F.round("mean_err", 7).alias("mean_err"))


KITEMS = f"""{WEIGHTED}, hi as ({sql_internal('weighted')}), pi as ({sql_internal('px')}), pal as (select image_id, x as idx, {', '.join(f'p{c} as q{c}' for c in 'argb')} from pi where y = 0),
cand as (select hi.image_id, hi.key, hi.weight, hi.pa, hi.pr, hi.pg, hi.pb, pal.idx, round({sql_difference('hi.p', 'pal.q')}, 9) as err from hi join pal using (image_id)),
near as (select * from cand qualify row_number() over (partition by image_id, key order by err, idx) = 1)"""


@query(f"with {KITEMS} select {longs('image_id', 'idx')}, round(sum(weight), 6) as popularity, " + ", ".join(f"round(sum(p{c} * weight) / sum(weight), 7) as q{c}" for c in "argb") + " from near group by image_id, idx")
def kmeans_one_step(spark, sf_dir):
    items = with_internal(histogram.finalized(hist(spark, sf_dir)))
    px = pixels(spark, sf_dir)
    start = palette_of(px)
    near = remap.nearest(items, start, 9)
    got = near.groupBy("image_id", "idx").agg(F.sum("weight").alias("w"), *(F.sum(F.col(f"p{c}") * F.col("weight")).alias(f"s{c}") for c in "argb"))
    return got.select("image_id", "idx", F.round("w", 6).alias("popularity"), *(F.round(F.col(f"s{c}") / F.col("w"), 7).alias(f"q{c}") for c in "argb"))


@query(f"with {NEAREST}, c as (select image_id, idx, count(*) as n from near group by image_id, idx) select {longs('image_id', 'idx', 'n')}, row_number() over (partition by image_id order by (a < 255) desc, n desc, idx) - 1 as new_idx from c join pal using (image_id, idx)")
def index_counts_reorder(spark, sf_dir):
    return remap.reordered(indexed(spark, sf_dir), palette_of(pixels(spark, sf_dir))).select("image_id", "idx", "n", "new_idx")


@query(f"""with {PX}, one as (select image_id, y, x, r as v from px where x < 12), two as (select image_id, y, x, g as v from px where x >= 4)
select cast(coalesce(one.image_id, two.image_id) as bigint) as image_id, cast(coalesce(one.y, two.y) as bigint) as y, cast(coalesce(one.x, two.x) as bigint) as x, least(one.v, two.v) as importance
from one full join two on one.image_id = two.image_id and one.y = two.y and one.x = two.x""")
def importance_merge(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return histogram.first_of_importance(px.filter("x < 12").withColumn("importance", F.col("r")), px.filter("x >= 4").withColumn("importance", F.col("g")))


@query(f"with {PX}, pal as (select image_id, x as idx, a, r as popularity from px where y = 0) select {longs('image_id', 'idx')}, row_number() over (partition by image_id order by (a < 255) desc, popularity desc, idx) - 1 as place from pal")
def transparent_palette_sort(spark, sf_dir):
    pal = pixels(spark, sf_dir).filter("y = 0").select("image_id", F.col("x").alias("idx"), "a", F.col("r").alias("popularity"))
    return remap.sorted_palette(pal).select("image_id", "idx", "place")


@query(f"with {PX} select {longs('image_id', 'y')}, x * 2 // 8 as at, cast(sum((r >> 6) << (6 - (x * 2) % 8)) as bigint) as byte, cast(4 as bigint) as row_bytes from px group by image_id, y, x * 2 // 8")
def bit_pack_rows(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("idx", F.shiftright("r", 6))
    return remap.packed_rows(px, 2).withColumn("row_bytes", E.row_bytes(F.lit(16), F.lit(2)))


def _second(c: str, part: str, order: str) -> str:
    w = f"over (partition by {part} order by {order})"
    v = f"({c} / 255.0::double)"
    return f"abs(2 * {v} - coalesce(lag({v}) {w}, {v}) - coalesce(lead({v}) {w}, {v}))"


_hh = "greatest(" + ", ".join(_second(c, "image_id, y", "x") for c in "rgba") + ")"
_vv = "greatest(" + ", ".join(_second(c, "image_id, x", "y") for c in "rgba") + ")"
CONTRAST = f"{PX}, hv as (select image_id, y, x, {_hh} as h, {_vv} as v from px), z as (select *, greatest(1 - greatest(greatest(h, v) - abs(h - v) * 0.5::double, least(h, v)), 0) as z from hv), contrast as (select {longs('image_id', 'y', 'x')}, round(h, 9) as h, round(v, 9) as v, cast(least(floor((z * z) * (z * z) * 176 + 80 + 1e-9::double), 255) as bigint) as noise, cast(least(greatest(floor((1 - greatest(h, v)) * 256 + 1e-9::double), 0), 255) as bigint) as edge from z)"


@query(f"with {CONTRAST} select * from contrast")
def contrast_second_diff(spark, sf_dir):
    return stencil.contrast(pixels(spark, sf_dir))


def _plus(c: str, f: str) -> str:
    pick = "greatest" if f == "max" else "least"
    return f"{pick}({f}({c}) over (partition by image_id, y order by x rows between 1 preceding and 1 following), {f}({c}) over (partition by image_id, x order by y rows between 1 preceding and 1 following))"


@query(f"with {PX} select {longs('image_id', 'y', 'x')}, {_plus('r', 'max')} as largest, {_plus('r', 'min')} as smallest from px")
def stencil_max3_min3(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("largest"), F.col("r").alias("smallest"))
    return stencil.plus_extreme(stencil.plus_extreme(px, "largest", True), "smallest", False)


def _blur(source: str, c: str, part: str, axis: str) -> str:
    w = f"partition by image_id, {part}"
    whole = f"over ({w} order by {axis} rows between unbounded preceding and unbounded following)"
    return f"select image_id, y, x, cast(floor((sum({c}) over ({w} order by {axis} rows between 2 preceding and 3 following) + greatest(0, 2 - {axis}) * first_value({c}) {whole} + greatest(0, {axis} + 3 - max({axis}) {whole}) * last_value({c}) {whole}) / 6.0::double) as bigint) as {c} from {source}"


@query(f"with {PX} select {longs('image_id', 'y', 'x')}, cast(r as bigint) as r from ({_blur('px', 'r', 'y', 'x')})")
def box_blur_1d(spark, sf_dir):
    return stencil.blurred(pixels(spark, sf_dir).select("image_id", "y", "x", "r"), "r", stencil.along_x(), "x")


_maps = [CONTRAST]
for _k, (_c, _f) in enumerate([("noise", "max"), ("noise", "max")]):
    _maps.append(f"n{_k} as (select image_id, y, x, edge, {_plus(_c, _f)} as noise from {'contrast' if _k == 0 else 'n0'})")
_maps += [f"b0 as ({_blur('n1', 'noise', 'y', 'x')})", f"b1 as ({_blur('b0', 'noise', 'x', 'y')})"]
for _k, _f in enumerate(("max", "min", "min", "min")):
    _maps.append(f"m{_k} as (select image_id, y, x, {_plus('noise', _f)} as noise from {'b1' if _k == 0 else f'm{_k - 1}'})")
for _k, _f in enumerate(("min", "max")):
    _maps.append(f"g{_k} as (select image_id, y, x, {_plus('edge', _f)} as edge from {'contrast' if _k == 0 else 'g0'})")


@query("with " + ", ".join(_maps) + " select image_id, y, x, noise, least(edge, noise) as edge from m3 join g1 using (image_id, y, x)")
def importance_maps(spark, sf_dir):
    return stencil.importance_maps(pixels(spark, sf_dir))


def _frames_of(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumnRenamed("image_id", "frame_no")
    return px.withColumns({c: E.posterize(F.col(c), 6) for c in "rgba"})


FR = PX + ", fr as (select image_id as frame_no, y, x, " + ", ".join(f"{c} & 192 as {c}" for c in "rgba") + " from px)"


@query(f"with {FR} select cast(n.frame_no as bigint) as frame_no, min(n.x) as x0, min(n.y) as y0, max(n.x) as x1, max(n.y) as y1, count(*) as pixels from fr n join fr o on n.frame_no = o.frame_no + 1 and n.y = o.y and n.x = o.x where n.r <> o.r or n.g <> o.g or n.b <> o.b or n.a <> o.a group by n.frame_no")
def frame_changed_rect(spark, sf_dir):
    return frames.changed_rectangles(_frames_of(spark, sf_dir))


@query("""with n as (select user_id, event_id, event_type, case when lag(event_type) over w = event_type then 0 else 1 end as new, row_number() over w as p from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by p) as run from n) select user_id, cast(run as bigint) as run, any_value(event_type) as event_type, count(*) as frames, cast(sum(event_id) as bigint) as total from r group by user_id, run""")
def frame_fold_duplicates(spark, sf_dir):
    return frames.folded(table(spark, sf_dir, "events"), "user_id", "ts,event_id", "event_type", "event_id")


@query(f"with {FR}, s as (select *, " + ", ".join(f"last_value(case when a > 0 then {c} end ignore nulls) over (partition by y, x order by frame_no rows between unbounded preceding and current row) as c{c}" for c in "rgba") + " from fr) select " + longs("frame_no", "y", "x") + ", " + ", ".join(f"cast(coalesce(c{c}, 0) as bigint) as {c}" for c in "rgba") + " from s")
def frame_compose_source(spark, sf_dir):
    return frames.composed_source(_frames_of(spark, sf_dir))


@query(f"with {FR}, c as (select a.frame_no, a.y, a.x, a.a / 255.0::double as sa, b.a / 255.0::double as da, " + ", ".join(f"a.{c} as s{c}1, b.{c} as d{c}1" for c in "rgb") + " from fr a join fr b on a.frame_no = b.frame_no + 1 and a.y = b.y and a.x = b.x), o as (select *, sa + da * (1.0::double - sa) as oa from c) select " + longs("frame_no", "y", "x") + ", " + ", ".join(f"cast(case when oa <= 1e-12 then 0 else floor((s{c}1 * sa + d{c}1 * da * (1.0::double - sa)) / oa + 0.5::double) end as bigint) as {c}" for c in "rgb") + ", cast(case when oa <= 1e-12 then 0 else floor(oa * 255.0::double + 0.5::double) end as bigint) as a from o")
def frame_blend_over(spark, sf_dir):
    fr = _frames_of(spark, sf_dir)
    before = fr.select((F.col("frame_no") + 1).alias("frame_no"), "y", "x", *(F.col(c).alias(f"d{c}") for c in "rgba"))
    got = fr.join(before, ["frame_no", "y", "x"])
    out = E.blend_over({c: F.col(c) for c in "rgba"}, {c: F.col(f"d{c}") for c in "rgba"})
    return got.select("frame_no", "y", "x", *(out[c].alias(c) for c in "rgba"))


@query(f"with {FR} select {longs('frame_no')}, cast(coalesce(max(x + 1) filter (a > 128), max(x + 1)) as bigint) as width, cast(coalesce(max(y + 1) filter (a > 128), max(y + 1)) as bigint) as height from fr group by frame_no")
def content_bounds(spark, sf_dir):
    fr = _frames_of(spark, sf_dir).withColumn("a", F.when(F.col("a") > 128, F.col("a")).otherwise(0))
    return frames.content_bounds(fr, "frame_no")


@query("""with d as (select l_orderkey, l_linenumber, cast(floor(l_quantity) as bigint) as n1, l_suppkey % 7 * 25 as d1, l_partkey % 60000 as n2, l_partkey % 5 * 25 as d2 from lineitem),
e as (select l_orderkey, l_linenumber, n1, case when d1 = 0 then 100 else d1 end as d1, n2, case when d2 = 0 then 100 else d2 end as d2 from d),
f as (select *, n1 * d2 + n2 * d1 as num, d1 * d2 as den, gcd(n1 * d2 + n2 * d1, d1 * d2) as g from e),
h as (select *, d1 = d2 and n1 + n2 <= 65535 as same, num // g <= 65535 and den // g <= 65535 as fits from f)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when same then n1 + n2 when fits then num // g else least(num * 1000 // den, 65535) end as bigint) as num, cast(case when same then d1 when fits then den // g else 1000 end as bigint) as den from h""")
def delay_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    num, den = E.merge_delays(F.floor("l_quantity").cast("long"), F.col("l_suppkey") % 7 * 25, F.col("l_partkey") % 60000, F.col("l_partkey") % 5 * 25, E.gcd_of_rows)
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), num.alias("num"), den.alias("den"))


STATS = "count(v) as n, round(coalesce(avg(v), 0), 6) as mean, round(coalesce(quantile_cont(v, 0.5), 0), 6) as median, coalesce(quantile_disc(v, 0.95), 0) as p95, coalesce(min(v), 0) as lowest, coalesce(max(v), 0) as highest, round(coalesce(max(v) - min(v), 0), 6) as spread"


@query(f"select l_returnflag, l_linestatus, {STATS} from (select *, l_extendedprice as v from lineitem) group by all")
def report_stats(spark, sf_dir):
    return report.statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query(f"select strftime(l_shipdate, '%Y-%m-%d') as day, {STATS} from (select *, l_quantity as v from lineitem) group by strftime(l_shipdate, '%Y-%m-%d')")
def report_stats_by_day(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return report.statistics(li, "l_quantity", ["day"])


@query("with m as (select o_orderpriority as metric, o_orderstatus as platform, avg(o_totalprice) as value from orders group by all), s as (select metric, min(value) as lowest, max(value) as highest from m group by metric) select metric, round(lowest, 6) as lowest, round(highest, 6) as highest, round(highest - lowest, 6) as spread, 2000.0::double as threshold, round(highest - lowest, 9) <= 2000 as passed from s")
def consistency_spread(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("platform")).agg(F.avg("o_totalprice").alias("value"))
    got = report.consistency(m, 2000.0)
    return got.select("metric", *(F.round(c, 6).alias(c) for c in ("lowest", "highest", "spread")), "threshold", "passed")


_samples = "select event_type as platform, cast(user_id as varchar) || '/' || strftime(ts, '%Y-%m-%d') as sample, md5(cast(event_id % 3 as varchar)) as digest from events"


@query(f"with s as ({_samples}), n as (select count(distinct platform) as platforms from s), p as (select sample, count(distinct platform) as there, count(distinct digest) as values_ from s group by sample) select sample, case when there < platforms then 'missing_output' else 'bytes_mismatch' end as reason, there, values_ as \"values\" from p, n where there < platforms or values_ > 1")
def cross_platform_missing(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    sample = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    return report.inconsistent(ev.select(F.col("event_type").alias("platform"), sample.alias("sample"), F.md5((F.col("event_id") % 3).cast("string").cast("binary")).alias("digest")))


_conclusion = "case event_id % 5 when 0 then 'failure' when 1 then 'cancelled' when 2 then 'skipped' else 'success' end"


@query(f"""with r as (select user_id as workflow, event_id as run_id, {_conclusion} as conclusion, ts as created from events), k as (select * from r qualify row_number() over (partition by workflow order by created desc, run_id desc) <= 20)
select workflow, count(*) as total, count(*) filter (conclusion = 'success') as success, count(*) filter (conclusion = 'failure') as failure, count(*) filter (conclusion = 'cancelled') as cancelled, count(*) filter (conclusion = 'skipped') as other,
 round(count(*) filter (conclusion = 'success') * 100.0::double / count(*), 6) as success_rate, arg_max(run_id, (created, run_id)) as last_run, arg_max(conclusion, (created, run_id)) as last_conclusion, arg_max(run_id, (created, run_id)) filter (conclusion = 'failure') as last_failure from k group by workflow""")
def trend_conclusions(spark, sf_dir):
    c = F.col("event_id") % 5
    conclusion = F.when(c == 0, "failure").when(c == 1, "cancelled").when(c == 2, "skipped").otherwise("success")
    return report.trends(table(spark, sf_dir, "events").select(F.col("user_id").alias("workflow"), F.col("event_id").alias("run_id"), conclusion.alias("conclusion"), F.col("ts").alias("created")), 20)


@query("select coalesce(source, 'UNKNOWN') as license, count(*) as packages from documents group by all")
def license_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("license")).agg(F.count("*").alias("packages"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def packages_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("select cast(doc_id as varchar) as path, octet_length(encode(text)) as size_bytes, sha256(text) as sha256 from documents")
def bundle_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    return report.manifest(d, "path", "text")


CASES = (("success", "ok", 0), ("missing_input", "argument", 2), ("quality_99", "quality_too_low", 98), ("tiny_with_size_gate", "output_too_large", 99), ("output_below_a_file", "io", 3), ("no_force", "argument", 2), ("damaged", "decode", 4))


@query("select * from (values " + ", ".join(f"('{c}', {code}::bigint, {E.LIBRARY_CODES.get(e, 0)}::bigint, true)" for c, e, code in CASES) + ") t(name, exit_code, library_code, passed)")
def compat_expectations(spark, sf_dir):
    cases = spark.createDataFrame(list(CASES), "name string, error string, expected long")
    code = E.code_of(F.col("error"))
    return cases.select("name", code.alias("exit_code"), E.code_of(F.col("error"), library=True).alias("library_code"), (code == F.col("expected")).alias("passed"))


@query("select count(*) as total, count(*) filter (o < i) as shrink, count(*) filter (o > i) as grow, count(*) filter (o = i) as same, round(sum(o) / sum(i)::double, 9) as ratio, bool_and(o <= i) as passed from (select cast(floor(o_totalprice) as bigint) as i, cast(floor(o_totalprice) as bigint) + o_orderkey % 3 - 1 as o from orders)")
def shrink_grow_totals(spark, sf_dir):
    i = F.floor("o_totalprice").cast("long")
    return report.size_changes(table(spark, sf_dir, "orders").select(i.alias("in_bytes"), (i + F.col("o_orderkey") % 3 - 1).alias("out_bytes")))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as keys from events")
def props_json_scan(spark, sf_dir):
    keys = F.json_object_keys("props")
    values = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(values, F.element_at(keys, 1)).alias("first_value"), F.size(keys).cast("long").alias("keys"))


@query("""with p as (select p_partkey, case p_partkey % 6 when 0 then cast(p_size as varchar) when 1 then '-' || p_size when 2 then p_size || '-' when 3 then p_size || '-' || (p_size + 20) when 4 then (p_size + 90) || '-' || p_size else 'x' || p_size end as t, p_size as s from part)
select p_partkey, t as text, cast(case p_partkey % 6 when 0 then floor(s * 0.9::double + 1e-9) when 1 then 0 when 2 then s when 3 then s end as bigint) as low, cast(case p_partkey % 6 when 0 then s when 1 then s when 2 then 100 when 3 then s + 20 end as bigint) as high from p""")
def quality_parse(spark, sf_dir):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, s).when(k == 1, F.concat(F.lit("-"), s)).when(k == 2, F.concat(s, F.lit("-"))).when(k == 3, F.concat(s, F.lit("-"), (F.col("p_size") + 20).cast("string"))).when(k == 4, F.concat((F.col("p_size") + 90).cast("string"), F.lit("-"), s)).otherwise(F.concat(F.lit("x"), s))
    low, high = E.parse_quality(F.col("text"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumns({"low": low, "high": high})


@query(f"with {PX} select {longs('image_id', 'y', 'x')}, " + ", ".join(f"({c} & 252) | ({c} >> 6) as {c}" for c in "rgba") + " from px")
def output_posterize(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", *(E.posterize_output(F.col(c), 2).alias(c) for c in "rgba"))


@query("select doc_id, regexp_replace(source || '/d' || doc_id || '.png', '(\\.[^./]*)?$', '-q8.png') as path, case when length(text) > 40 then substr(text, 1, 40) || '...' else text end as shown from documents")
def output_names(spark, sf_dir):
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "documents").select("doc_id", E.output_path(path, "-q8.png").alias("path"), E.truncated(F.col("text"), 40).alias("shown"))


@query("select l_shipmode, n, failed, n - failed as passed from (select l_returnflag as l_shipmode, count(*) as n, count(*) filter (not case when l_linestatus = 'O' then l_quantity < 40 else l_quantity >= 10 end) as failed from lineitem group by all)")
def smoke_expectation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    expected = F.col("l_linestatus") == "O"
    code = F.when(expected, F.when(F.col("l_quantity") < 40, 0).otherwise(4)).otherwise(F.when(F.col("l_quantity") >= 10, 2).otherwise(0))
    got = li.select(F.col("l_returnflag").alias("l_shipmode"), report.expectation(expected, code).alias("ok"))
    return got.groupBy("l_shipmode").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("ok").alias("passed"))


@query("select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49) as \"exists\" from part")
def release_existence(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return report.existence(table(spark, sf_dir, "part").select("p_partkey"), there, "p_partkey")


def _items(spark, sf_dir):
    weighted = histogram.finalized(hist(spark, sf_dir))
    return with_internal(weighted).select("image_id", *(f"p{c}" for c in "argb"), "weight")


@query()
def median_cut_palette(spark, sf_dir):
    return palette.search_palettes(_items(spark, sf_dir), palette.Search(colours=16), refine=False)


@query()
def find_best_palette(spark, sf_dir):
    """The search of the default speed, 256 colours, over the histogram that this speed takes."""
    from . import quantize

    options = quantize.Options()
    items = with_internal(quantize.histograms(pixels(spark, sf_dir).withColumn("noise", F.lit(255).cast("long")), options))
    return palette.search_palettes(items.select("image_id", *(f"p{c}" for c in "argb"), "weight"), palette.Search.of_speed(options.speed, options.max_colours))


@query()
def dither_map(spark, sf_dir):
    edges = stencil.importance_maps(pixels(spark, sf_dir)).select("image_id", "y", "x", "edge")
    return dither.dither_map(indexed(spark, sf_dir).select("image_id", "y", "x", "idx").join(edges, ["image_id", "y", "x"]))


def _dithered(spark, sf_dir):
    px = with_internal(pixels(spark, sf_dir)).withColumn("strength", F.lit(255))
    palettes = palette.search_palettes(_items(spark, sf_dir), palette.Search(colours=16), refine=False)
    return dither.diffused(px, palettes), palettes


@query()
def floyd_steinberg(spark, sf_dir):
    return _dithered(spark, sf_dir)[0]


@query(f"with {NEAREST} select cast(near.image_id as bigint) as image_id, cast(y as bigint) as y, cast(x as bigint) as x, pal.r, pal.g, pal.b, pal.a from near join pal using (image_id, idx)")
def png_round_trip(spark, sf_dir):
    """Pixels remapped to a palette, encoded as indexed PNG files, and decoded again."""
    files = png.encoded_images(indexed(spark, sf_dir), palette_of(pixels(spark, sf_dir)))
    files = files.select(F.col("image_id").cast("string").alias("path"), "content")
    return png.image_pixels(files).select(F.col("path").cast("long").alias("image_id"), "y", "x", *"rgba")


@query()
def quantize_images(spark, sf_dir):
    """End to end: histogram, palette search, remap, score, encode; one row per image."""
    from . import quantize

    return quantize.quantize(pixels(spark, sf_dir), quantize.Options()).drop("content")


def _animation(spark, sf_dir, colour=None):
    """Images as animations: 64 rows of pixels are 16 frames of 4 rows; the last frame may be shorter."""
    px = pixels(spark, sf_dir)
    drawn = px.select((F.col("image_id") * 1_000_000 + F.floor(F.col("y") / 64)).alias("anim"), F.floor(F.col("y") % 64 / 4).alias("frame_no"), (F.col("y") % 4).alias("y"), "x", *"rgba")
    if colour:
        drawn = drawn.withColumns(colour)
    made = drawn.groupBy("anim", "frame_no").agg(F.lit(16).cast("long").alias("w"), (F.max("y") + 1).alias("h"))
    zero = F.lit(0).cast("long")
    made = made.withColumns({"x_off": zero, "y_off": zero, "delay_num": F.col("frame_no") + 1, "delay_den": F.lit(10).cast("long"), "dispose": F.lit("none"), "blend": F.lit("source")})
    sizes = drawn.groupBy("anim").agg(F.lit(16).cast("long").alias("width"), (F.max("y") + 1).alias("height"))
    return sizes, made, drawn


AN = PX + ", an as (select image_id * 1000000 + y // 64 as anim, y % 64 // 4 as frame_no, y % 4 as y, x, r, g, b, a from px)"
#: Frames replace the canvas, so a cell shows the last frame that has it.
SHOWN = "gr as (select distinct f.anim, f.frame_no, c.y, c.x from an f join an c on f.anim = c.anim and c.frame_no = 0), sh as (select gr.anim, gr.frame_no, gr.y, gr.x, last_value(v.c ignore nulls) over (partition by gr.anim, gr.y, gr.x order by gr.frame_no rows between unbounded preceding and current row) as c from gr left join col v on gr.anim = v.anim and gr.frame_no = v.frame_no and gr.y = v.y and gr.x = v.x), ch as (select *, lag(c) over (partition by anim, y, x order by frame_no) is distinct from c as changed from sh)"


def _flat(**own):
    """One opaque colour, but for the channels given."""
    return {c: F.lit(v).cast("long") for c, v in zip("rgba", (255, 0, 0, 255))} | own


@query(f"""with {AN}, col as (select anim, frame_no, y, x, case when r >= 128 and g >= 128 and b >= 128 then 200 else 10 end as c from an), {SHOWN},
bx as (select anim, frame_no, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from ch where changed and frame_no > 0 group by all),
fr as (select anim, frame_no, max(y) + 1 as h from an group by all)
select {longs('anim', 'frame_no')}, cast(case when frame_no = 0 then 16 else coalesce(x1 - x0 + 1, 1) end as bigint) as w, cast(case when frame_no = 0 then h else coalesce(y1 - y0 + 1, 1) end as bigint) as h,
 cast(case when frame_no = 0 then 0 else coalesce(x0, 0) end as bigint) as x_off, cast(case when frame_no = 0 then 0 else coalesce(y0, 0) end as bigint) as y_off from fr left join bx using (anim, frame_no)""")
def animation_minimise(spark, sf_dir):
    some = (F.col("r") >= 128) & (F.col("g") >= 128) & (F.col("b") >= 128)
    own = _animation(spark, sf_dir, _flat(r=F.when(some, 200).otherwise(10).cast("long")))
    return animation.checked_minimised_frames(*own)[0].select("anim", "frame_no", "w", "h", "x_off", "y_off")


@query(f"""with {AN}, fc as (select anim, frame_no, max(r) filter (y = 0 and x = 0) & 128 as c from an group by all), col as (select anim, frame_no, y, x, fc.c from an join fc using (anim, frame_no)), {SHOWN},
mv as (select anim, frame_no, max(cast(changed as int)) as changed from ch group by all), ru as (select anim, frame_no, sum(changed) over (partition by anim order by frame_no) - 1 as run from mv)
select {longs('anim')}, cast(run as bigint) as frame_no, cast(sum(frame_no + 1) as bigint) as delay_num, cast(10 as bigint) as delay_den from ru group by anim, run""")
def animation_fold(spark, sf_dir):
    first = F.max(F.when((F.col("y") == 0) & (F.col("x") == 0), F.col("r"))).over(Window.partitionBy("anim", "frame_no"))
    own = _animation(spark, sf_dir, _flat(r=first.bitwiseAND(F.lit(128))))
    return animation.folded_frames(*own)[0].select("anim", "frame_no", "delay_num", "delay_den")


@query(f"""with {AN}, al as (select anim, frame_no, y, x, case when x + 4 * y > (max(r) filter (y = 0 and x = 0) over (partition by anim, frame_no)) % 28 then 0 else 255 end as a from an),
wh as (select *, max(y) over (partition by anim) + 1 as height from al)
select {longs('anim', 'frame_no')}, cast(case when max(y) + 1 = any_value(height) then coalesce(max(x + 1) filter (a > 0), 16) else 16 end as bigint) as w, cast(case when max(y) + 1 = any_value(height) then coalesce(max(y + 1) filter (a > 0), max(y) + 1) else max(y) + 1 end as bigint) as h, count(*) filter (max_y < 0) as cut from (select *, 0 as max_y from wh) group by anim, frame_no""")
def animation_trim(spark, sf_dir):
    first = F.max(F.when((F.col("y") == 0) & (F.col("x") == 0), F.col("r"))).over(Window.partitionBy("anim", "frame_no"))
    own = _animation(spark, sf_dir, _flat(a=F.when(F.col("x") + 4 * F.col("y") > first % 28, 0).otherwise(255).cast("long")))
    made, drawn = animation.trimmed_frames(*own)
    outside = drawn.join(made.select("anim", "frame_no", "w", "h"), ["anim", "frame_no"]).groupBy("anim", "frame_no").agg(F.count_if((F.col("x") >= F.col("w")) | (F.col("y") >= F.col("h"))).alias("cut"))
    return made.join(outside, ["anim", "frame_no"]).select("anim", "frame_no", "w", "h", "cut")


def _blending(spark, sf_dir):
    sizes, made, drawn = _animation(spark, sf_dir, {c: E.posterize(F.col(c), 5) for c in "rgba"})
    n = F.col("frame_no")
    return sizes, made.withColumns({"dispose": F.element_at(F.array(*(F.lit(d) for d in png.DISPOSE)), (n % 3 + 1).cast("int")), "blend": F.when(n % 2 == 1, "over").otherwise("source")}), drawn


@query()
def animation_quantize(spark, sf_dir):
    """End to end: fold, trim, one palette, background-aware remap, worst score, encode; one row per animation."""
    from . import animate, quantize

    return animate.quantize_animations(*_blending(spark, sf_dir), quantize.Options()).drop("content")


_levels = "least(greatest(2 + image_id * 10 * 30 // 100 - 2, 2), 32)"


def _sql_level(c: str, n: str) -> str:
    return f"cast(floor(floor({c} / 255.0::double * ({n} - 1)::double + 0.5::double) / ({n} - 1)::double * 255.0::double + 0.5::double) as bigint) as {c}"


@query(f"with {PX}, lv as (select *, {_levels} as n, greatest({_levels} // 2, 4) as m from px) select {longs('image_id', 'y', 'x')}, {', '.join(_sql_level(c, 'n') for c in 'rgb')}, {_sql_level('a', 'm')} from lv")
def level_quantize(spark, sf_dir):
    return levels.levelled(pixels(spark, sf_dir), levels.levels_of(F.col("image_id") * 10, F.lit(4)))


@query()
def level_quantize_diffused(spark, sf_dir):
    return levels.levelled_diffused(pixels(spark, sf_dir), 8)


@query("""select cast(l_orderkey as bigint) as sample_id, sum(l_extendedprice * (1 - l_discount)) as candidate, sum(l_extendedprice) as baseline from lineitem group by l_orderkey""".replace("select cast", "with b as (select cast", 1) + ") select sample_id, round(candidate, 4) as candidate, round(baseline, 4) as baseline, round((candidate - baseline) / baseline, 9) as delta_vs_baseline from b")
def baseline_deltas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("sample_id", F.col("l_orderkey").cast("long"))
    run = lambda v: li.groupBy("sample_id").agg(F.sum(v).alias("size"))
    got = report.deltas(run(F.col("l_extendedprice") * (1 - F.col("l_discount"))), run(F.col("l_extendedprice")), "size")
    return got.select("sample_id", *(F.round(c, 4).alias(c) for c in ("candidate", "baseline")), F.round("delta_vs_baseline", 9).alias("delta_vs_baseline"))


@query("""with r as (select o_orderkey, case o_orderkey % 7 when 0 then 'Q_HIGH' when 1 then 'Q_LOW' when 2 then 'FAST' when 3 then 'NO_DITHER' when 4 then 'FUNC_BASE' when 5 then 'Q_MED' else 'OTHER' end as profile from orders)
select o_orderkey, profile, case profile when 'Q_HIGH' then '70-90' when 'Q_LOW' then '35-55' when 'FUNC_BASE' then null else '55-75' end as quality, cast(case profile when 'Q_HIGH' then 3 when 'Q_LOW' then 6 when 'FAST' then 10 else 4 end as bigint) as speed,
 case profile when 'NO_DITHER' then 'nofs' else 'fs' end as dither from r""")
def profile_parameters(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ("Q_HIGH", "Q_LOW", "FAST", "NO_DITHER", "FUNC_BASE", "Q_MED", "OTHER")))
    return report.profiled(table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("profile")))


@query("""with r as (select case when event_id % 4 = 0 then null else event_id % 4 = 1 end as expected, event_id % 3 as code, event_type = 'purchase' and event_id % 11 = 0 as crash from events)
select count(*) as cases, count(*) filter (crash) as crash_like, count(*) filter (case when expected then code <> 0 when not expected then code = 0 else false end) as failures, not bool_or(crash or case when expected then code <> 0 when not expected then code = 0 else false end) as passed from r""")
def stability_counts(spark, sf_dir):
    n = F.col("event_id")
    crash = (F.col("event_type") == "purchase") & (n % 11 == 0)
    return report.stability(table(spark, sf_dir, "events").select(F.when(n % 4 != 0, n % 4 == 1).alias("expected_success"), (n % 3).alias("exit_code"), F.when(crash, "thread PANICked").alias("stderr"), F.lit(False).alias("signalled")))


@query(f"with {PX}, p as ({sql_internal('px')}), n as (select image_id, y, x + 1 as x, pa as na, pr as nr, pg as ng, pb as nb from p) select {longs('image_id', 'y', 'x')}, {', '.join(f'round(2 * p{c} - n{c}, 9) as m{c}' for c in 'argb')} from p join n using (image_id, y, x)")
def reflected_colour(spark, sf_dir):
    p = with_internal(pixels(spark, sf_dir)).select("image_id", "y", "x", *(f"p{c}" for c in "argb"))
    before = p.select("image_id", "y", (F.col("x") + 1).alias("x"), *(F.col(f"p{c}").alias(f"n{c}") for c in "argb"))
    out = E.reflected(E.colour(), E.colour("n"))
    return p.join(before, ["image_id", "y", "x"]).select("image_id", "y", "x", *(F.round(v, 9).alias(f"m{c}") for c, v in zip("argb", out)))


@query("""with e as (select event_id, event_id % 300 - 20 as x, event_id % 70 - 3 as y, event_id % 256 as w, case when event_id % 50 = 0 then 9000000000000000000 else event_id % 64 end as h from events)
select event_id, case when w * h::hugeint * 4 <= 9223372036854775807 then cast(w * h::hugeint * 4 as bigint) end as n_bytes,
 case when x >= 0 and x < w and y >= 0 and y < h and w * h::hugeint * 4 <= 9223372036854775807 then cast((y * w + x) * 4 as bigint) end as place from e""")
def checked_rgba_places(spark, sf_dir):
    n = F.col("event_id")
    x, y, w = n % 300 - 20, n % 70 - 3, n % 256
    h = F.when(n % 50 == 0, F.lit(9000000000000000000)).otherwise(n % 64)
    return table(spark, sf_dir, "events").select("event_id", E.rgba_bytes(w, h).alias("n_bytes"), E.rgba_place(x, y, w, h).alias("place"))


@query("""with f as (select event_id, case event_id % 4 when 0 then '-' when 1 then 'out/x.png' end as output, case when event_id % 3 = 0 then '-' else 'in.d/p' || event_id || case when event_id % 2 = 0 then '.png' else '' end end as source from events)
select event_id, coalesce(output, case when source = '-' then '-' else regexp_replace(source, '[.][^./]*$', '') || '-fs8.png' end) as target from f""")
def output_routing(spark, sf_dir):
    n = F.col("event_id")
    output = F.when(n % 4 == 0, "-").when(n % 4 == 1, "out/x.png")
    source = F.when(n % 3 == 0, "-").otherwise(F.concat(F.lit("in.d/p"), n, F.when(n % 2 == 0, ".png").otherwise("")))
    return table(spark, sf_dir, "events").select("event_id", E.output_target(output, source, "-fs8.png").alias("target"))


@query("""with e as (select event_id, ['argument', 'io', 'decode', 'encode', 'quality_too_low', 'output_too_large'][event_id % 7 + 1] as error, event_type as detail, case when event_id % 2 = 0 then 'a/b.png' end as path, event_id % 100 as n from events)
select event_id, error, case error when 'argument' then detail when 'io' then 'io error' || coalesce(' at ' || path, '') || ': ' || detail when 'decode' then 'decode error: ' || detail when 'encode' then 'encode error: ' || detail
 when 'quality_too_low' then 'quality too low: actual=' || n || ', minimum=' || (n + 1)
 when 'output_too_large' then 'skip-if-larger rejected output: input=' || (n * 10) || ' bytes, output=' || (n * 20) || ' bytes, max_allowed=' || (n * 5) || ' bytes, quality_score=' || n end as message from e""")
def error_texts(spark, sf_dir):
    n = F.col("event_id") % 100
    names = F.array(*(F.lit(x) for x in ("argument", "io", "decode", "encode", "quality_too_low", "output_too_large")))
    error = F.get(names, (F.col("event_id") % 7).cast("int"))
    numbers = {"minimum": n + 1, "actual": n, "in_bytes": n * 10, "out_bytes": n * 20, "most_bytes": n * 5, "score": n}
    message = E.error_text(error, F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "a/b.png"), numbers)
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"), message.alias("message"))


@query("""select event_id, case when event_id % 12 = 0 then 4 else event_id % 12 end as speed, case when event_id % 5 = 0 then 1.0::double else (event_id % 5) / 5.0::double end as dither,
 nullif(event_id % 4, 0) as posterize, case when event_id % 3 = 1 then 'aggressive' else 'safe' end as mode from events""")
def library_options(spark, sf_dir):
    n = F.col("event_id")
    out = E.library_options(n % 12, F.when(n % 5 == 0, -1.0).otherwise((n % 5) / 5.0), n % 4, n % 3)
    return table(spark, sf_dir, "events").select("event_id", *(v.alias(k) for k, v in out.items()))


@query("""with e as (select event_id, event_id % 99 as n, case event_id % 3 when 0 then null when 1 then '60-80' else '70' end as requested, case event_id % 6 when 2 then '70-70' when 1 then '60-80' when 4 then '60-80' when 5 then '70' end as effective from events)
select event_id, 'ok: ' || n || 'x' || (n + 1) || ', ' || coalesce('requested_quality=' || requested || ', ', '') || case when requested <> effective then 'effective_quality=' || effective || ', ' else '' end || 'quality_score=' || n ||
 ', quality_mse=' || printf('%.3f', n / 8.0::double) || ', ' || (n * 100) || ' -> ' || (n * 40) || ' bytes, wrote a/' || event_id || '.png' as message from e""")
def success_messages(spark, sf_dir):
    k = F.col("event_id")
    n = k % 99
    requested = F.when(k % 3 == 1, "60-80").when(k % 3 == 2, "70")
    effective = F.when(k % 6 == 2, "70-70").when(k % 6 == 5, "70").when(k % 3 == 1, "60-80")
    path = F.concat(F.lit("a/"), k, F.lit(".png"))
    return table(spark, sf_dir, "events").select("event_id", E.success_text(n, n + 1, requested, effective, n, n / 8.0, n * 100, n * 40, path).alias("message"))


@query("select cast(map_from_entries(list((platform, n) order by platform)) as varchar) as shown from (select event_type as platform, count(*) as n from events group by event_type)")
def report_map(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("platform")).agg(F.count("*").alias("n"))
    entries = F.map_entries("entries")
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.as_map(counts, "platform", "n").select(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("shown"))
