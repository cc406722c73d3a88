"""Literal vectors for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from chromaflow.functions import expr as E


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("n_in, quality, most", [(1000, 100, 999), (1000, 10, 499), (1000, 75, 648), (0, 50, 0)])
def test_size_gate(spark, n_in, quality, most):
    assert value(spark, E.most_bytes(F.lit(n_in), F.lit(quality))) == most


@pytest.mark.parametrize("n_in, quality, most", [(323238, 87, 262301), (289118, 75, 187787)])
def test_size_gate_just_below_a_whole_number(spark, n_in, quality, most):
    """Products less than a millionth below a whole number: the SQL's floor counts them as that number."""
    assert value(spark, E.most_bytes(F.lit(n_in), F.lit(quality))) == most


@pytest.mark.parametrize("text, want", [("55-80", (55, 80)), ("70", (63, 70)), ("-80", (0, 80)), ("65-", (65, 100)), ("80-55", (None, None)), ("hello", (None, None)), ("30-300", (None, None))])
def test_quality_range(spark, text, want):
    low, high = E.parse_quality(F.lit(text))
    assert tuple(spark.range(1).select(low, high).first()) == want


def test_quality_scale(spark):
    table = {1: 0.008554511140, 20: 0.001320418606, 55: 0.000627240389, 75: 0.000319898653, 99: 0.000012723161}
    for q, mse in table.items():
        assert value(spark, E.quality_to_mse(F.lit(q))) == pytest.approx(mse, abs=1e-12)
        assert value(spark, E.mse_to_quality(E.quality_to_mse(F.lit(q)))) == q
    got = [r[0] for r in spark.range(101).orderBy("id").select(E.quality_to_mse(F.col("id"))).collect()]
    assert got == sorted(got, reverse=True)


def test_posterize(spark):
    assert [value(spark, E.posterize(F.lit(v).cast("long"), 2)) for v in (255, 127, 63, 31)] == [252, 124, 60, 28]
    assert [value(spark, E.posterize_output(F.lit(v).cast("long"), 2)) for v in (131, 255)] == [130, 255]


def test_budgets(spark):
    assert value(spark, E.iterations_of_speed(F.lit(4))) == 12
    few = E.effective_target(F.lit(0.004), F.lit(0.009), F.lit(128), F.lit(256))
    many = E.effective_target(F.lit(0.004), F.lit(0.009), F.lit(2048), F.lit(256))
    assert value(spark, few) == pytest.approx(0.00297) and value(spark, many) == pytest.approx(0.004)


@pytest.mark.parametrize("one, two, want", [((1, 10), (2, 10), (3, 10)), ((1, 10), (1, 20), (3, 20)), ((60000, 1), (60000, 1), (65535, 1000)), ((1, 0), (1, 100), (2, 100))])
def test_delays(spark, one, two, want):
    num, den = E.merge_delays(*(F.lit(v) for v in (*one, *two)))
    assert tuple(spark.range(1).select(num, den).first()) == want


def test_blend_and_codes(spark):
    over = E.blend_over({c: F.lit(v) for c, v in zip("rgba", (0, 255, 0, 128))}, {c: F.lit(v) for c, v in zip("rgba", (255, 0, 0, 255))})
    assert [value(spark, over[c]) for c in "rgba"] == [127, 128, 0, 255]
    assert value(spark, E.code_of(F.lit("decode"))) == 4 and value(spark, E.code_of(F.lit("decode"), library=True)) == 3
    assert value(spark, E.output_path(F.lit("a.b/c.png"), "-q.png")) == "a.b/c-q.png"
    assert [value(spark, E.bit_depth(F.lit(n))) for n in (2, 4, 16, 17)] == [1, 2, 4, 8]


def test_damage_is_deterministic(spark):
    raw = bytes(range(40))
    rows = spark.range(10).select("id", E.mutated(F.lit(raw), F.col("id")).alias("m")).collect()
    again = spark.range(10).select("id", E.mutated(F.lit(raw), F.col("id")).alias("m")).collect()
    assert rows == again and all(bytes(r["m"]) != raw for r in rows)
