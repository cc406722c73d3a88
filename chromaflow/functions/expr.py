"""Scalar functions of the colour quantiser as Column expressions.

Everything is built-in Catalyst but :func:`gcd_of_rows`, which takes Arrow batches: no Python
runs per row. Bytes are LONG columns in 0..255; all real arithmetic is DOUBLE. Nulls
give null.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the colour model.
GAMMA_OUT = 0.45455
GAMMA_IN = 0.57
WEIGHT_A, WEIGHT_R, WEIGHT_G, WEIGHT_B = 0.625, 0.5, 1.0, 0.45
MSE_SCALE = 0.45
MOST_U32 = 4294967295
TRANSPARENT_BYTES = (71, 112, 76, 0)

EXIT_CODES = {"argument": 2, "io": 3, "decode": 4, "encode": 4, "quality_too_low": 98, "output_too_large": 99}
LIBRARY_CODES = {"argument": 1, "io": 2, "decode": 3, "encode": 4, "quality_too_low": 98, "output_too_large": 99}


class Colour(NamedTuple):
    """A colour in the internal space: alpha, red, green, blue, weighted and premultiplied."""

    a: Column
    r: Column
    g: Column
    b: Column


def colour(prefix: str = "p") -> Colour:
    return Colour(*(F.col(prefix + c) for c in "argb"))


def reflected(c: Colour, of: Colour) -> Colour:
    """The colour as far beyond ``c`` as ``of`` is before it."""
    return Colour(*(2 * x - y for x, y in zip(c, of)))


def to_byte(v: Column) -> Column:
    """Clamp to 0..255, then cut the fraction."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("long")


def linear(byte: Column) -> Column:
    return F.pow(byte / 255.0, F.lit(GAMMA_IN / GAMMA_OUT))


def internal(r: Column, g: Column, b: Column, a: Column) -> Colour:
    alpha = a / 255.0
    return Colour(WEIGHT_A * alpha, WEIGHT_R * linear(r) * alpha, WEIGHT_G * linear(g) * alpha, WEIGHT_B * linear(b) * alpha)


def is_transparent(c: Colour) -> Column:
    return c.a < WEIGHT_A / 255.0


def difference(s: Colour, o: Colour) -> Column:
    """Squared distance of two colours, on black or on white, whichever is larger in each channel."""
    da = o.a - s.a

    def worse(x: Column, y: Column) -> Column:
        black, white = x - y, x - y + da
        return F.greatest(black * black, white * white)

    return worse(s.r, o.r) + (worse(s.g, o.g) + worse(s.b, o.b))


def to_rgba(c: Colour) -> tuple[Column, Column, Column, Column]:
    """Bytes r, g, b, a of an internal colour; fully transparent ones are all 0."""
    clear = c.a <= WEIGHT_A / 255.0
    alpha = c.a / WEIGHT_A

    def channel(v: Column, weight: float) -> Column:
        return F.when(clear, F.lit(0).cast("long")).otherwise(to_byte(F.pow(F.greatest(v / weight / alpha, F.lit(0.0)), F.lit(GAMMA_OUT / GAMMA_IN)) * 256.0))

    return channel(c.r, WEIGHT_R), channel(c.g, WEIGHT_G), channel(c.b, WEIGHT_B), F.when(clear, F.lit(0).cast("long")).otherwise(to_byte(c.a * (256.0 / WEIGHT_A)))


def quality_to_mse(q: Column) -> Column:
    q = q.cast("double")
    extra = F.greatest(0.016 / (0.001 + q) - 0.001, F.lit(0.0))
    return F.when(q == 0, F.lit(1e20)).when(q >= 100, F.lit(0.0)).otherwise(MSE_SCALE * (extra + 2.5 / F.pow(210.0 + q, F.lit(1.2)) * (100.1 - q) / 100.0))


def mse_to_quality(m: Column) -> Column:
    """The best score whose error allows ``m``; 0 if none does."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(100)), lambda q: m <= quality_to_mse(q) + 1e-6)
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def standard_mse(m: Column) -> Column:
    return m * 65536.0 / 6.0 / MSE_SCALE


def most_bytes(n_in: Column, quality: Column) -> Column:
    """Size gate: most bytes an output may have; a product within a millionth of the next whole number counts as that one, as in the SQL."""
    return F.floor(F.greatest(n_in - 1, F.lit(0)) * F.greatest(F.pow(quality / 100.0, F.lit(1.5)), F.lit(0.5)) + F.lit(1e-6)).cast("long")


def posterize(byte: Column, bits: int) -> Column:
    return byte.bitwiseAND(F.lit(255 & ~((1 << bits) - 1)).cast("long"))


def posterize_output(byte: Column, bits: int) -> Column:
    return posterize(byte, bits).bitwiseOR(F.shiftright(byte, 8 - bits)) if bits else byte


def colour_key(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(r + g * 256 + b * 65536 + a * 16777216)


def cluster(r: Column, g: Column, b: Column, a: Column) -> Column:
    top = lambda c: F.shiftright(c, 7)
    return (top(r) * 8 + top(g) * 4 + top(b) * 2 + top(a)).cast("long")


def saturating_sum(c: Column) -> Column:
    return F.least(F.sum(c), F.lit(MOST_U32)).cast("long")


def blend_over(s: dict[str, Column], d: dict[str, Column]) -> dict[str, Column]:
    """Source over destination, channels r g b a as bytes."""
    sa, da = s["a"] / 255.0, d["a"] / 255.0
    out = sa + da * (1.0 - sa)
    none = out <= 1e-12
    round_half_up = lambda v: F.floor(v + 0.5).cast("long")
    got = {c: F.when(none, F.lit(0).cast("long")).otherwise(round_half_up((s[c] * sa + d[c] * da * (1.0 - sa)) / out)) for c in "rgb"}
    return got | {"a": F.when(none, F.lit(0).cast("long")).otherwise(round_half_up(out * 255.0))}


def effective_dispose(dispose: Column, frame_no: Column) -> Column:
    return F.when((frame_no == 0) & (dispose == "previous"), F.lit("background")).otherwise(dispose)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of LONGs below 2**33: Euclid's steps, 48 at most, as a fold, which also runs inside a lambda."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"])


def gcd_of_rows(a: Column, b: Column) -> Column:
    """As :func:`gcd` for a table's rows, a batch at once in numpy; null where either is."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def divisor(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        return pd.Series(np.gcd(x.where(known, 0).astype("int64"), y.where(known, 0).astype("int64"))).astype("Int64").where(known)

    return divisor(a.cast("long"), b.cast("long"))


def merge_delays(n1: Column, d1: Column, n2: Column, d2: Column, divisor=gcd) -> tuple[Column, Column]:
    """Sum of two delays num/den (a den of 0 means 100) with parts below 65536; else in ms, capped. ``divisor`` is gcd_of_rows outside of lambdas."""
    d1, d2 = (F.when(d == 0, F.lit(100)).otherwise(d).cast("long") for d in (d1, d2))
    n1, n2 = n1.cast("long"), n2.cast("long")
    num, den = n1 * d2 + n2 * d1, d1 * d2
    same = (d1 == d2) & (n1 + n2 <= 65535)

    def by(g: Column) -> Column:
        g = F.greatest(g, F.lit(1).cast("long"))
        cut_n, cut_d = F.floor(num / g), F.floor(den / g)
        cross = (cut_n <= 65535) & (cut_d <= 65535)
        ms = F.least(F.floor(num * 1000 / den), F.lit(65535))
        return F.struct(F.when(same, n1 + n2).when(cross, cut_n).otherwise(ms).alias("n"), F.when(same, d1).when(cross, cut_d).otherwise(F.lit(1000)).alias("d"))

    # one element: the divisor is computed once and bound
    out = F.element_at(F.transform(F.array(F.when(same, F.lit(1).cast("long")).otherwise(divisor(num, den))), by), 1)
    return out["n"].cast("long"), out["d"].cast("long")


def parse_quality(text: Column) -> tuple[Column, Column]:
    """(min, max) of N, -N, N- or A-B with 0..100 and A <= B; nulls if malformed."""
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")
    one, upto, from_ = part(r"^(\d{1,9})$"), part(r"^-(\d{1,9})$"), part(r"^(\d{1,9})-$")
    low, high = part(r"^(\d{1,9})-\d{1,9}$"), part(r"^\d{1,9}-(\d{1,9})$")
    a = F.coalesce(F.floor(one * 0.9 + 1e-9), F.when(upto.isNotNull(), 0), from_, low).cast("long")
    b = F.coalesce(one, upto, F.when(from_.isNotNull(), 100), high).cast("long")
    good = (a >= 0) & (b <= 100) & (a <= b)
    return F.when(good, a), F.when(good, b)


def parse_dither(text: Column) -> Column:
    v = text.try_cast("double")
    return F.when(v.between(0.0, 1.0), v)


def rgba_bytes(width: Column, height: Column) -> Column:
    """Bytes of an image; null where a LONG cannot hold them."""
    return F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), F.lit(4).cast("long"))


def rgba_place(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Place of a pixel's first byte; null outside of the image."""
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside & rgba_bytes(width, height).isNotNull(), (y.cast("long") * width + x) * 4)


def output_target(output: Column, source: Column, extension: str) -> Column:
    """Where a result goes: the output asked for, the standard output ('-') for the standard input, else beside the source."""
    return F.coalesce(output, F.when(source == "-", source).otherwise(output_path(source, extension)))


def output_path(path: Column, extension: str) -> Column:
    """Parent and stem with another ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def code_of(error: Column, library: bool = False) -> Column:
    out = F.lit(0)
    for name, code in (LIBRARY_CODES if library else EXIT_CODES).items():
        out = F.when(error == name, F.lit(code)).otherwise(out)
    return out.cast("long")


def error_text(error: Column, detail: Column, path: Column, numbers: dict[str, Column]) -> Column:
    """What an error says; ``numbers``: minimum, actual, in_bytes, out_bytes, most_bytes, score."""
    n = {k: v.cast("string") for k, v in numbers.items()}
    too_large = F.concat(
        F.lit("skip-if-larger rejected output: input="), n["in_bytes"], F.lit(" bytes, output="), n["out_bytes"], F.lit(" bytes, max_allowed="), n["most_bytes"], F.lit(" bytes, quality_score="), n["score"]
    )
    return (
        F.when(error == "argument", detail)
        .when(error == "io", F.concat(F.lit("io error"), F.coalesce(F.concat(F.lit(" at "), path), F.lit("")), F.lit(": "), detail))
        .when(error.isin("decode", "encode"), F.concat(error, F.lit(" error: "), detail))
        .when(error == "quality_too_low", F.concat(F.lit("quality too low: actual="), n["actual"], F.lit(", minimum="), n["minimum"]))
        .when(error == "output_too_large", too_large)
    )


def success_text(width: Column, height: Column, requested: Column, effective: Column, score: Column, mse: Column, in_bytes: Column, out_bytes: Column, path: Column) -> Column:
    """What a written file says; the quality asked for only where one was, the effective one only where it differs."""
    asked = F.when(requested.isNotNull(), F.concat(F.lit("requested_quality="), requested, F.lit(", ")))
    other = F.when(requested != effective, F.concat(F.lit("effective_quality="), effective, F.lit(", ")))
    none = F.lit("")
    return F.concat(
        F.lit("ok: "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(", "), F.coalesce(asked, none), F.coalesce(other, none),
        F.lit("quality_score="), score.cast("string"), F.lit(", quality_mse="), F.format_string("%.3f", mse), F.lit(", "),
        in_bytes.cast("string"), F.lit(" -> "), out_bytes.cast("string"), F.lit(" bytes, wrote "), path,
    )


def library_options(speed: Column, dither: Column, posterize: Column, mode: Column) -> dict[str, Column]:
    """Options as a library caller gives them, made whole: 0 and negative values stand for the defaults."""
    return {
        "speed": F.when(speed == 0, 4).otherwise(speed).cast("long"),
        "dither": F.when(dither < 0, 1.0).otherwise(dither).cast("double"),
        "posterize": F.nullif(posterize.cast("long"), F.lit(0).cast("long")),
        "mode": F.when(mode == 1, "aggressive").otherwise("safe"),
    }


def iterations_of_speed(speed: Column) -> Column:
    i = F.greatest(8 - F.least(speed, F.lit(10)), F.lit(0)).cast("long")
    return (i + F.floor(i * i / 2)).cast("long")


def backed_off(n: Column, items: Column) -> Column:
    """A budget cut to three quarters (rounded up) at each of four histogram sizes."""
    for limit in (5_000, 25_000, 50_000, 100_000):
        n = F.when(items > limit, F.ceil(n * 3 / 4)).otherwise(n)
    return n.cast("long")


def effective_target(target: Column, most: Column, items: Column, colours: Column, bits: int = 0) -> Column:
    few = F.when(items <= colours, F.least(target, most * 0.33)).otherwise(target)
    floor = (2.0**bits / 1024.0) ** 2 if bits else 0.0
    return F.least(F.greatest(few, F.lit(floor)), most)


def bit_depth(n_colours: Column) -> Column:
    return F.when(n_colours <= 2, 1).when(n_colours <= 4, 2).when(n_colours <= 16, 4).otherwise(8).cast("long")


def row_bytes(width: Column, depth: Column) -> Column:
    return F.ceil(width * depth / 8).cast("long")


def mutated(content: Column, seed: Column) -> Column:
    """A deterministic damage of bytes by seed % 5: cut, flip, overwrite, insert, append."""
    n = F.greatest(F.length(content), F.lit(1))
    at = F.pmod(F.xxhash64(seed, content), n.cast("long")).cast("int")
    head, tail = F.substring(content, F.lit(1), at), lambda k: F.substring(content, at + 1 + k, n)
    noise = F.unhex(F.lpad(F.hex(F.abs(F.xxhash64(seed))), 16, "0"))
    empty = F.unhex(F.lit(""))
    flipped = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0"))
    kind = F.pmod(seed, F.lit(5))
    return (
        F.when(kind == 0, head)
        .when(kind == 1, F.concat(head, F.coalesce(flipped, empty), tail(1)))
        .when(kind == 2, F.concat(head, noise, tail(8)))
        .when(kind == 3, F.concat(head, noise, tail(0)))
        .otherwise(F.concat(content, noise))
    )
