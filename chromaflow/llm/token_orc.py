"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by doc_id and sorted inside each shard, so files
follow one another in ascending doc_id, every stripe and row group covers a narrow
id range, and a reader that asks for some ids skips the rest by the stripes'
minimum and maximum and their Bloom filters. Each row has its shard and the number
of ids before it in the shard; the shards' totals (one row each) give global
starts. Readers split files by stripe.

One shuffle moves the texts; the ids are made after it, where they are written.
A worker holds a batch, the vocabulary and a bounded cache of pieces.

Defined cases: a null text is empty and has the end id alone; rows without doc_id
come first; rows that share a doc_id are ordered by text; an empty table gives
files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces as P
from .common import map_arrow, shared_path, stream_arrow, table, texts

END_ID = 1
#: ORC writer settings: stripes are what readers split by, strides what they skip by.
WRITER = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, shard int, offset long, n_tokens long, ids array<int>"


class WordEncoder(P.ColumnEncoder):
    """Ids by the tokenizers library; each new piece goes through it once."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, new: list[str]) -> None:
        """As one text, whose ids are cut where a piece ends."""
        for k in range(0, len(new), 1000):
            some = new[k : k + 1000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(some):
                raw, a = ids.tobytes(), 0
                for piece, b in zip(some, stops.tolist()):
                    self.known[piece] = raw[a:b]
                    a = b
            else:
                for piece, got in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                    self.known[piece] = np.array(got.ids, "<u4").tobytes()


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_orc(documents: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes SCHEMA in ascending doc_id to the folder ``out``, one file a shard."""
    path = path or P.default_vocabulary()
    spark = documents.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = encoder(batch.column(1))
            n = n + 1
            stop = np.cumsum(n)
            last = np.zeros(int(stop[-1]), bool)
            last[stop - 1] = True
            whole = np.full(len(last), end_id, np.int32)
            whole[~last] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(whole))
            yield {"doc_id": batch.column(0), "shard": np.full(len(n), shard, np.int32), "offset": before + stop - n, "n_tokens": n, "ids": lists}
            before += int(stop[-1])

    # rows that share a doc_id, or have none, are dealt by how their texts begin
    ordered = texts(documents).repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    stream_arrow(ordered, run, SCHEMA).write.options(**WRITER).orc(out)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids in all rows before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row a shard: their number is the writer's parameter, not the data's size
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """SCHEMA of some documents; stripes and row groups without them are skipped by index and Bloom filter, nothing else is read."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin([int(i) for i in ids]))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batch):
        ids = batch.column(3)
        bounds = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return {"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2), "ids_crc32": crc}

    return map_arrow(rows.select("doc_id", "start", "n_tokens", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), out)
    return digests(read_token_orc(spark, out))
