"""What the operators of this subpackage share: tables, Arrow batches, shared storage."""

from __future__ import annotations

import atexit
import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: a batch of long texts must fit beside a worker's tables.
BATCH_ROWS = 10_000
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of the operators that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Returns what a worker freed to its machine: Spark uses workers again, and they would keep a task's most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow where ``fn`` turns a batch into columns in the order of ``schema``."""
    small_batches(df.sparkSession)
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record_batch(fn(batch), kinds)
        give_back()

    return df.mapInArrow(run, schema)


def stream_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where ``fn`` sees a partition's batches one after another."""
    small_batches(df.sparkSession)
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield record_batch(out, kinds)
        give_back()

    return df.mapInArrow(run, schema)


def record_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    out = []
    for field in kinds:
        x = columns[field.name]
        out.append((x if x.type == field.type else x.cast(field.type)) if isinstance(x, pa.Array) else pa.array(x, field.type))
    return pa.RecordBatch.from_arrays(out, schema=kinds)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, in the cluster's spark.checkpoint.dir; removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    """Where the session names no folder: one of this machine's, which only a local master shares with its executors."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "/tmp/checkpoints")
    return "/tmp/checkpoints"


#: Folders written by this driver, with the session that wrote them; and, in a thread that runs :func:`settled`, those written in it.
_written: list[tuple[SparkSession, str]] = []
_scope = threading.local()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def release() -> None:
    """Removes all intermediate folders written so far. Frames that were not read yet are lost."""
    while _written:
        _remove(*_written.pop())


def _remove_all() -> None:
    """At the driver's end; what cannot be reached any more (a stopped JVM) stays for the cluster's own cleaning."""
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        release()
    except (Py4JError, Py4JNetworkError, AttributeError, OSError):
        _written.clear()


#: Spark then removes a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors. Its shuffle files go when it is written."""
    path = shared_path(df.sparkSession, name)
    with _without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written; the folders written meanwhile are removed, so nothing else may read them."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        result, inner = build(), _scope.paths
    finally:
        _scope.paths = outer
    out = materialise(result, name)
    for entry in [x for x in _written if x[1] in set(inner)]:
        _written.remove(entry)
        _remove(*entry)
    return out


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text, null text as empty, whatever other columns there are."""
    return df.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Ids that may be broadcast: 16 MB at most. Beyond, the joins that follow move the whole table.
BROADCAST_IDS = 1_000_000


def split_by_ids(df: DataFrame, ids: DataFrame, column: str = "row") -> tuple[DataFrame, DataFrame | None]:
    """(rows that may be among ``ids``, the others): all rows and None where the ids are too many to broadcast. ``ids`` has distinct values, written before."""
    if ids.count() > BROADCAST_IDS:
        return df, None
    few = F.broadcast(ids.select(column))
    return df.join(few, column, "left_semi"), df.join(few, column, "left_anti")


def few_broadcast(ids: DataFrame) -> DataFrame:
    """``ids``, written before, marked for broadcast where they are few: the join then moves no texts."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ordinals(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """``df`` with its place (from 0) in the order of ``order``, without one task seeing all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordinals")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_base")
    return ranged.join(F.broadcast(bases), "_part").withColumn(name, place.cast("long")).drop("_part", "_base")


def with_rows(documents: DataFrame) -> tuple[DataFrame, bool]:
    """(row, doc_id, text, copies) with a unique ``row`` in the order of doc_id, and whether it is doc_id itself.

    Where doc_ids repeat or are null, equal (doc_id, text) count as one row with
    ``copies``, and rows that share a doc_id follow one another by text.
    """
    plain = texts(documents)
    odd = plain.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return plain.select(F.col("doc_id").alias("row"), "doc_id", "text", F.lit(1).alias("copies")), True
    merged = plain.groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("copies"))
    return materialise(ordinals(merged, "doc_id", "text").select("row", "doc_id", "text", "copies"), "rows"), False


def as_often(df: DataFrame) -> DataFrame:
    """Each row ``copies`` times, without that column."""
    return df.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).drop("copies", "_copy")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def int64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
