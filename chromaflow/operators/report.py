"""Report analytics over run tables: plain aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """rows, mean, median, p95 (nearest rank), lowest, highest, spread of a column; zeros where there are no values."""
    v = df.withColumn("_v", F.col(value).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [
        F.count("_v").alias("n"),
        F.round(zero(F.avg("_v")), 6).alias("mean"),
        F.round(zero(F.percentile("_v", F.lit(0.5))), 6).alias("median"),
        zero(F.expr("percentile_disc(0.95) within group (order by _v)")).alias("p95"),
        zero(F.min("_v")).alias("lowest"),
        zero(F.max("_v")).alias("highest"),
        F.round(zero(F.max("_v") - F.min("_v")), 6).alias("spread"),
    ]
    return v.groupBy(*by).agg(*aggs) if by else v.agg(*aggs)


def consistency(metrics: DataFrame, threshold: float) -> DataFrame:
    """metric, lowest, highest, spread, threshold, passed over (platform, metric, value)."""
    got = metrics.groupBy("metric").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    spread = F.round(F.col("highest") - F.col("lowest"), 9)
    return got.select("metric", "lowest", "highest", spread.alias("spread"), F.lit(threshold).alias("threshold"), (spread <= threshold).alias("passed"))


def inconsistent(samples: DataFrame) -> DataFrame:
    """Over (platform, sample, digest): samples that a platform lacks (missing_output) or whose digests differ (bytes_mismatch)."""
    platforms = samples.select("platform").distinct().agg(F.count("*").alias("platforms"))
    per = samples.groupBy("sample").agg(F.count_distinct("platform").alias("there"), F.count_distinct("digest").alias("values"))
    got = per.crossJoin(F.broadcast(platforms))
    reason = F.when(F.col("there") < F.col("platforms"), "missing_output").when(F.col("values") > 1, "bytes_mismatch")
    return got.withColumn("reason", reason).filter("reason is not null").select("sample", "reason", "there", "values")


def trends(runs: DataFrame, newest: int) -> DataFrame:
    """Per workflow over its ``newest`` runs (1 at least): counts by conclusion, success rate in percent, the latest run and the latest failure. ``runs``: workflow, run_id, conclusion, created."""
    place = F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("created"), F.desc("run_id")))
    kept = runs.withColumn("_n", place).filter(F.col("_n") <= max(newest, 1))
    is_ = lambda *c: F.col("conclusion").isin(*c)
    latest = F.struct("created", "run_id")
    return kept.groupBy("workflow").agg(
        F.count("*").alias("total"),
        F.count_if(is_("success")).alias("success"),
        F.count_if(is_("failure")).alias("failure"),
        F.count_if(is_("cancelled")).alias("cancelled"),
        F.count_if(~is_("success", "failure", "cancelled")).alias("other"),
        F.round(F.count_if(is_("success")) * 100.0 / F.count("*"), 6).alias("success_rate"),
        F.max_by("run_id", latest).alias("last_run"),
        F.max_by("conclusion", latest).alias("last_conclusion"),
        F.max_by("run_id", F.when(is_("failure"), latest)).alias("last_failure"),
    )


def size_changes(runs: DataFrame) -> DataFrame:
    """shrink, grow, same, the ratio of summed sizes, and whether none grew. ``runs``: in_bytes, out_bytes."""
    return runs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("out_bytes") < F.col("in_bytes")).alias("shrink"),
        F.count_if(F.col("out_bytes") > F.col("in_bytes")).alias("grow"),
        F.count_if(F.col("out_bytes") == F.col("in_bytes")).alias("same"),
        F.round(F.coalesce(F.sum("out_bytes") / F.sum("in_bytes"), F.lit(0.0)), 9).alias("ratio"),
        F.bool_and(F.col("out_bytes") <= F.col("in_bytes")).alias("passed"),
    )


def expectation(expected_success: Column, exit_code: Column) -> Column:
    """Did a run end as its sample expects."""
    return F.when(expected_success, exit_code == 0).otherwise(exit_code != 0)


def crash_like(stderr: Column, signalled: Column) -> Column:
    return F.coalesce(F.lower(stderr).contains("panic"), F.lit(False)) | signalled


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, size_bytes, sha256."""
    raw = F.col(content).cast("binary")
    return files.select(F.col(path).alias("path"), F.length(raw).cast("long").alias("size_bytes"), F.sha2(raw, 256).alias("sha256"))


def existence(required: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return required.join(there.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").select(*required.columns, F.col("_there").isNotNull().alias("exists"))


def written_csv(rows: DataFrame, formats: dict[str, str], path: str, force: bool = False) -> None:
    """A CSV report with fixed number formats for some columns."""
    shown = [F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in rows.columns]
    rows.select(*shown).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def as_map(rows: DataFrame, key: str, value: str, name: str = "entries") -> DataFrame:
    """One row: a map of all rows. The report's rows are few; of a repeated key the largest value stays."""
    one = rows.groupBy(key).agg(F.max(value).alias(value))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def summary_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object of its columns in order, nulls included, two spaces a level."""
    shown = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "pretty": "true"})
    return rows.select(shown.alias("json"))


def markdown(rows: DataFrame) -> DataFrame:
    """One line of a table per row."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |")).alias("line"))


def deltas(candidate: DataFrame, baseline: DataFrame, value: str, by: str = "sample_id") -> DataFrame:
    """Per sample that both runs have: both values, candidate minus baseline, and their ratio less one (null where the baseline is 0)."""
    both = candidate.select(by, F.col(value).alias("candidate")).join(baseline.select(by, F.col(value).alias("baseline")), by)
    gap = F.col("candidate") - F.col("baseline")
    return both.withColumns({"delta": gap, "delta_vs_baseline": F.try_divide(gap.cast("double"), F.col("baseline").cast("double"))})


#: Quality range, speed and dithering of the evaluation profiles; others count as Q_MED.
PROFILES = (
    ("Q_HIGH", "70-90", 3, "fs"),
    ("Q_MED", "55-75", 4, "fs"),
    ("Q_LOW", "35-55", 6, "fs"),
    ("FAST", "55-75", 10, "fs"),
    ("NO_DITHER", "55-75", 4, "nofs"),
    ("FUNC_BASE", None, 4, "fs"),
)


def profiled(runs: DataFrame, profile: str = "profile") -> DataFrame:
    """``runs`` with the quality, speed and dither of their profile."""
    known = {name: (quality, speed, dither) for name, quality, speed, dither in PROFILES}
    out = [F.lit(v) for v in known["Q_MED"]]
    for name, values in known.items():
        out = [F.when(F.col(profile) == name, F.lit(v)).otherwise(o) for v, o in zip(values, out)]
    return runs.withColumns({"quality": out[0].cast("string"), "speed": out[1].cast("long"), "dither": out[2]})


def stability(runs: DataFrame) -> DataFrame:
    """Cases, crash-like ones, failures, and whether none crashed or failed. ``runs``: expected_success (null: any end that is no crash), exit_code, stderr, signalled."""
    crash = crash_like(F.col("stderr"), F.col("signalled"))
    bad = F.coalesce(~expectation(F.col("expected_success"), F.col("exit_code")) & F.col("expected_success").isNotNull(), F.lit(False))
    return runs.agg(F.count("*").alias("cases"), F.count_if(crash).alias("crash_like"), F.count_if(bad).alias("failures"), F.coalesce(F.bool_and(~crash & ~bad), F.lit(True)).alias("passed"))


def suites(results: DataFrame) -> DataFrame:
    """passed: did every suite of (suite, passed) pass; and how many did not."""
    return results.agg(F.count("*").alias("suites"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
