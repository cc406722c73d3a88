"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document may be copied 0, 1 or 2 times. Among all laws of the copies that
meet every source's token target, the one of least relative entropy to the fair
law tilts each document exponentially by its tokens: its mean is the rate
2 / (1 + exp(-multiplier * size / mean size of the source)). The multipliers
minimise the convex dual; distributed Newton steps solve it for all sources at
once, each step one aggregation of a histogram of document sizes. Rates become
copies by rounding running sums over sizes, then by moving single copies until no
whole copy brings a source nearer to its target.

What grows with the corpus stays distributed: documents are touched twice
(measured, then joined with their cell), the rest works on distinct (source,
size) pairs. A cell also has a salt, so that a source or size with a third of all
rows is dealt over many tasks. A source's window runs over its distinct sizes,
which the longest document bounds. The driver holds single numbers.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 are taken 0 times; an empty table gives no rows;
rows that share a doc_id are separate documents of the same rank; other columns
are ignored. Reruns agree: ranks come from a hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_broadcast, free, materialise, settled, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
#: Newton steps end when every source is this near to its target (share of it), or after so many.
NEAR, MOST_STEPS = 1e-7, 60
#: Multipliers are rounded to so many digits: sums of doubles differ in their last bits from run to run.
DIGITS = 10
#: Copies move until every source's words are this near to its target (share of it), or no copy helps.
ROUNDED, MOST_MOVES = 1e-5, 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, spark: SparkSession) -> DataFrame:
    """key, n, source_size, mean, target of each source: weights dealt in the order of keys, shares stopped at MOST times the size and dealt anew."""
    sources = sizes.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(sources.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    bases = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("base")
    weighed = ranged.join(F.broadcast(bases), "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")))
    weighed = materialise(weighed.select("key", "n", "source_size", "weight"), "mix-weights")

    cap = F.lit(MOST) * F.col("source_size")
    total = BUDGET * float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit, full = 0.0, -1
    while True:
        stopped = cap <= F.lit(unit) * F.col("weight")
        got = weighed.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(stopped, 1)).alias("stopped"),
        ).first()
        if got["stopped"] == full or not got["weight"]:
            break
        full = got["stopped"]
        unit = (total - got["taken"]) / got["weight"]
    return weighed.select(
        "key", "n", "source_size", (F.col("source_size") / F.col("n")).alias("mean"), F.least(cap, F.lit(unit) * F.col("weight")).cast("double").alias("target")
    )


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.lit(MOST) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * size / mean))))


def balance(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """key, size, n and the rate of each size. ``histogram``: key, size, n."""
    share = F.col("target") / (F.lit(MOST) * F.col("source_size"))
    full = F.col("target") >= F.lit(MOST) * F.col("source_size") * (1 - 1e-12)
    state = targets.filter("source_size > 0").select(
        "key", "mean", "target", full.alias("full"), F.when(full, 0.0).otherwise(F.log(share / (1 - share))).alias("multiplier"), F.lit(1.0).alias("off")
    )
    rows = materialise(histogram.filter("size > 0"), "mix-histogram")
    for _ in range(MOST_STEPS):
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"))
        tokens = F.col("n") * F.col("size")
        moments = (
            rows.join(state.filter("not full"), "key")
            .groupBy("key")
            .agg(F.sum(tokens * rate).alias("got"), F.sum(tokens * rate * (1 - rate / MOST) * F.col("size") / F.col("mean")).alias("slope"))
        )
        step = (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        most = F.abs(F.col("multiplier")) + 2.0
        state = materialise(
            state.join(moments, "key", "left").select(
                "key", "mean", "target", "full",
                F.when(F.col("full") | F.col("got").isNull(), F.col("multiplier")).otherwise(F.round(F.col("multiplier") - F.greatest(-most, F.least(most, step)), DIGITS)).alias("multiplier"),
                F.when(F.col("full") | F.col("got").isNull(), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.col("target")).alias("off"),
            ),
            "mix-newton",
        )
        off = state.agg(F.max("off")).first()[0] or 0.0
        if off <= NEAR:
            break
    else:
        raise RuntimeError(f"the dual is not solved: a source is {off:g} of its target away after {MOST_STEPS} steps")
    rate = F.when(F.col("full"), F.lit(MOST)).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean")))
    return rows.join(state, "key").select("key", "size", "n", "target", rate.alias("rate"))


def copies_of_sizes(rates: DataFrame) -> DataFrame:
    """key, size, n and copies: how many copies all documents of a source and size get together."""
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = rates.withColumn("upto", F.round(upto).cast("long"))
    state = state.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    state = materialise(state.select("key", "size", "n", "target", "copies"), "mix-copies")
    for _ in range(MOST_MOVES):
        left = state.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"), F.first("target").alias("aim"))
        left = left.filter(F.abs("left") > ROUNDED * F.col("aim")).select("key", "left")
        room = F.when(F.col("left") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        movable = state.join(left, "key").withColumn("room", room.cast("long")).filter("room > 0 and size <= abs(left)")
        # the largest sizes first, as long as all of their copies fit, then what fits of the next: the sizes that can move shrink each time
        upto = F.sum(F.col("size") * F.col("room")).over(down.rowsBetween(Window.unboundedPreceding, -1))
        rest = F.abs("left") - F.coalesce(upto, F.lit(0))
        moved = movable.withColumn("move", F.least("room", F.floor(rest / F.col("size")))).filter("move > 0")
        moved = materialise(moved.select("key", "size", (F.signum("left") * F.col("move")).cast("long").alias("move")), "mix-moves")
        if moved.isEmpty():
            break
        state = materialise(
            state.join(moved, ["key", "size"], "left").select("key", "size", "n", "target", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")), "mix-copies"
        )
    else:
        raise RuntimeError(f"copies still move after {MOST_MOVES} rounds")
    return state.select("key", "size", "n", "copies")


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``documents`` (doc_id, text, source)."""
    spark = documents.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))
    sizes = materialise(documents.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size")), "mix-sizes")
    salts = 16 + sizes.count() // 1_000_000
    rank = F.xxhash64(F.col("doc_id"))
    salted = sizes.withColumn("salt", F.pmod(rank, F.lit(salts)))
    targets = materialise(source_targets(sizes, spark), "mix-targets")
    cells = materialise(salted.groupBy("key", "size", "salt").agg(F.count("*").alias("here")), "mix-cells")
    histogram = cells.groupBy("key", "size").agg(F.sum("here").alias("n"))
    copies = copies_of_sizes(balance(histogram, targets))

    base = F.floor(F.col("copies") / F.col("n"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = (
        cells.join(copies, ["key", "size"], "left")
        .withColumn("base", F.coalesce(base, F.lit(0)).cast("long"))
        .withColumn("extra", F.coalesce(F.col("copies") - F.col("base") * F.col("n"), F.lit(0)))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("here"), F.col("extra") - before)))
        .join(targets.select("key", "source_size", "target"), "key")
        .select("key", "size", "salt", "base", "extra", "source_size", "target")
    )
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(rank, F.col("doc_id")))
    out = salted.withColumn("place", place).join(dealt, ["key", "size", "salt"])
    n = F.when(F.col("size") > 0, F.col("base") + (F.col("place") <= F.col("extra")).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.when(F.col("key") != "~", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken")
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``documents`` as many times as it is taken, with its columns.

    Rows that share a doc_id, or have none, are matched by size, then in the order of text.
    """
    id_, size_, place_, copies_, copy_ = free(documents, "id_taken", "size_taken", "place_taken", "copies_taken", "copy_taken")
    odd = documents.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        taken = settled("mix-taken", lambda: mix(documents).filter("copies > 0").select(F.col("doc_id").alias(id_), F.col("copies").alias(copies_)))
        found = documents.join(few_broadcast(taken), F.col("doc_id") == F.col(id_))
    else:
        taken = settled("mix-taken", lambda: mix(documents))
        order = F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.desc("copies")))
        taken = taken.select(F.col("doc_id").alias(id_), F.col("size").alias(size_), order.alias(place_), F.col("copies").alias(copies_)).filter(F.col(copies_) > 0)
        own = F.row_number().over(Window.partitionBy("doc_id", word_count(F.col("text"))).orderBy("text"))
        place_own = free(documents, "place_own")[0]
        rows = documents.withColumn(place_own, own)
        found = rows.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & (word_count(F.col("text")) == F.col(size_)) & (F.col(place_own) == F.col(place_)))
    return found.withColumn(copy_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies_)))).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
