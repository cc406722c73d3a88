"""Relations that the catalogue's queries run on.

The test data hold no images, so pixels are derived from ``embeddings``: a label is an
image, each of its vectors a row of 16 pixels, four components a pixel. The same
relation is spelled for DuckDB in :data:`PX`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b, a as LONG."""
    y = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), y.alias("y"), "embedding")
    byte = lambda i, k: E.to_byte((F.element_at("embedding", (i * 4 + k + 1).cast("int")).cast("double") + 0.5) * 255.0)
    cell = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.struct(i.cast("long").alias("x"), *(byte(i, k).alias(c) for k, c in enumerate("rgba"))),
    )
    return rows.select("image_id", "y", F.inline(cell))


PX = """rr as (select cast(label as bigint) as image_id, row_number() over (partition by label order by vec_id) - 1 as y, embedding from embeddings),
u as (select image_id, y, unnest(range(0, 64)) as pos, unnest(embedding) as v from rr),
e as (select image_id, y, pos, cast(greatest(0, least(255, floor((cast(v as double) + 0.5) * 255))) as bigint) as c from u),
px as (select image_id, y, pos // 4 as x, max(case when pos % 4 = 0 then c end) as r, max(case when pos % 4 = 1 then c end) as g,
 max(case when pos % 4 = 2 then c end) as b, max(case when pos % 4 = 3 then c end) as a from e group by all)"""


def with_internal(px: DataFrame, prefix: str = "p") -> DataFrame:
    c = E.internal(*(F.col(k) for k in "rgba"))
    return px.withColumns({prefix + k: v for k, v in zip("argb", c)})


def sql_internal(source: str, prefix: str = "p", keep: str = "*") -> str:
    """A select that adds the internal colour of r, g, b, a."""
    lut = lambda c: f"pow({c} / 255.0::double, {E.GAMMA_IN / E.GAMMA_OUT!r})"
    return (
        f"select {keep}, 0.625::double * (a / 255.0::double) as {prefix}a, 0.5::double * {lut('r')} * (a / 255.0::double) as {prefix}r, "
        f"1.0::double * {lut('g')} * (a / 255.0::double) as {prefix}g, 0.45::double * {lut('b')} * (a / 255.0::double) as {prefix}b from {source}"
    )


def sql_difference(s: str, o: str) -> str:
    worse = lambda c: f"greatest(pow({s}{c} - {o}{c}, 2), pow({s}{c} - {o}{c} + ({o}a - {s}a), 2))"
    return f"({worse('r')} + ({worse('g')} + {worse('b')}))"


def sql_mse_of(q: str) -> str:
    return f"(case when {q} = 0 then 1e20 when {q} >= 100 then 0 else 0.45::double * (greatest(0.016::double / (0.001::double + {q}) - 0.001::double, 0) + 2.5::double / pow(210.0::double + {q}, 1.2::double) * (100.1::double - {q}) / 100.0::double) end)"
