"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are whole numbers. The index holds blocks of vectors, those of the longest
first; a block's postings (dimension, slot, value) are grouped into segments of one
quantised impact, the highest first, and inside a segment by dimension. Queries come
in batches of a fixed size, each batch to every block: the index stays where it is.
In a block, segments are added to the scores by descending impact, dense ones by a
matrix product, sparse ones posting list by posting list. What the segments still to
come can add to a score is at most the product of the query's norm and the norm of the
vector's rest. Vectors that this puts below the query's k-th best proven score (in the
block, or in the first blocks, whose results all blocks know) are dropped; a query
whose possible members are few stops and scores these exactly. There is no other stop:
without proof all segments are processed.

Memory of a task: a block, a batch of queries and the scores of QUERY_BLOCK of them.
The shuffles are that of the vectors into blocks, and k rows of a task for a query.

Defined cases: a vector that is null or holds null, NaN or infinity takes no part, nor
does a row without vec_id; missing trailing components count as 0; components and
scores beyond the range of a long count as its ends; candidates that share the query's
vec_id are left out; rows that repeat a vec_id are candidates each, and of repeated
query ids the row with the smallest vector asks; ties go to the smaller vec_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, stream_arrow, table

#: Components in a block; queries whose scores are held at once; components in a batch of queries (16 MB), which is broadcast.
CELLS, QUERY_BLOCK, BATCH_CELLS = 1 << 18, 512, 1 << 21
#: Lower bounds of the quantised impacts, descending; above the first, each octave is a segment of its own.
IMPACTS = (16, 8, 4, 1)
#: A query stops when at most this many times k vectors of a block are possible members.
FEW = 4
#: Blocks whose results bound the others'.
FIRST = 2
LONGEST = (1 << 63) - 1

INDEX = "number long, ids array<long>, width int, impacts array<long>, bounds array<int>, dims array<int>, slots array<int>, numbers array<long>"
FOUND = "query_id long, vec_id long, score long"


def whole(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    fit = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(embedding.isNotNull() & fit, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, padded with 0."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(ends)
    width = int(n.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(int(n.sum())) - np.repeat(ends[:-1] - ends[0], n)] = flat[ends[0] : ends[-1]]
    return out


def sizes(m: np.ndarray) -> np.ndarray:
    """Absolute values; the smallest long has that of the largest."""
    return np.abs(np.maximum(m, -LONGEST))


@dataclass
class Block:
    """Postings by impact, then dimension, then slot; bounds are those of the segments."""

    ids: np.ndarray
    width: int
    impacts: np.ndarray
    bounds: np.ndarray
    dims: np.ndarray
    slots: np.ndarray
    numbers: np.ndarray

    def full(self) -> np.ndarray:
        m = np.zeros((len(self.ids), self.width), np.int64)
        m[self.slots, self.dims] = self.numbers
        return m


def segmented(ids: np.ndarray, m: np.ndarray) -> Block:
    """The block of some vectors."""
    size = sizes(m)
    top = int(size.max(initial=0))
    floors = np.array([x for x in (1 << b for b in range(62, 4, -1)) if x <= top] + list(IMPACTS), np.int64)
    slots, dims = np.nonzero(size)
    numbers = m[slots, dims]
    segment = np.searchsorted(-floors, -size[slots, dims])
    order = np.lexsort((slots, dims, segment))
    bounds = np.searchsorted(segment[order], np.arange(len(floors) + 1))
    return Block(ids, m.shape[1], floors, bounds, dims[order], slots[order], numbers[order])


def build_index(vectors: DataFrame) -> DataFrame:
    """One row for each block of ``vectors`` (vec_id, v array<long>); block 0 of a partition holds its longest vectors."""
    spark = vectors.sparkSession
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    rows = max(1, CELLS // width)
    parts = max(1, -(-vectors.count() // rows))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dealt = vectors.withColumn("norm", norm).repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        def out(ids, vs) -> dict:
            own = segmented(np.concatenate(ids), np.concatenate(vs))
            names = ("ids", "impacts", "bounds", "dims", "slots", "numbers")
            return {"number": [number], "width": [own.width]} | {k: pa.array([getattr(own, k)]) for k in names}

        number, held, ids, vs = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, rows - held)
                ids.append(some.column(0).to_numpy(zero_copy_only=False))
                vs.append(matrix(some.column(1), width))
                at, held = at + some.num_rows, held + some.num_rows
                if held == rows:
                    yield out(ids, vs)
                    number, held, ids, vs = number + 1, 0, [], []
        if held:
            yield out(ids, vs)

    return stream_arrow(dealt.select("vec_id", "v"), run, INDEX)


def best_of_block(block: Block, query_ids: np.ndarray, queries: np.ndarray, k: int, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of the k best of a block for each query, as far as scores reach ``at_least``; and the segments that each query processed."""
    width = max(block.width, queries.shape[1])
    q = np.zeros((len(queries), width), np.int64)
    q[:, : queries.shape[1]] = queries
    full = np.zeros((len(block.ids), width), np.int64)
    full[:, : block.width] = block.full()
    ids, steps = block.ids, np.zeros(len(q), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most = int(sizes(q).max(initial=0)) * int(sizes(full).max(initial=0)) * max(width, 1)

    def emit(place: int, members: np.ndarray) -> None:
        if most > LONGEST:
            exact = full[members].astype(object) @ q[place].astype(object)
            exact = np.array([max(-LONGEST - 1, min(LONGEST, int(x))) for x in exact], np.int64)
        else:
            exact = full[members] @ q[place]
        fit = ids[members] != query_ids[place]
        members, exact = ids[members][fit], exact[fit]
        # of equal scores the smallest ids; ~x orders descending without the overflow of -x
        order = np.lexsort((members, ~exact))[:k]
        out.append((np.full(len(order), place), members[order], exact[order]))

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), steps
        return *(np.concatenate(x) for x in zip(*out)), steps

    if most >= 1 << 53:
        for place in range(len(q)):
            emit(place, np.arange(len(ids)))
        return done()

    kind = np.float32 if most < 1 << 24 else np.float64
    qf = q.astype(kind)
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    n_segments = len(block.impacts)
    rest = np.zeros((n_segments + 1, len(ids)))
    for s in range(n_segments - 1, -1, -1):
        own = slice(block.bounds[s], block.bounds[s + 1])
        rest[s] = rest[s + 1] + np.bincount(block.slots[own], weights=block.numbers[own].astype(float) ** 2, minlength=len(ids))
    rest = np.sqrt(rest) * (1 + 1e-6)
    active = np.flatnonzero(norm * rest[0].max(initial=0.0) * (1 + 1e-6) >= at_least)
    alive = np.arange(len(ids))
    scores = np.zeros((len(active), len(ids)), kind)
    for s in range(n_segments):
        if not len(active) or not len(alive):
            break
        own = slice(block.bounds[s], block.bounds[s + 1])
        _add(scores, qf[active], block.dims[own], block.slots[own], block.numbers[own].astype(kind), alive, len(ids), width)
        steps[active] = s + 1
        last = s == n_segments - 1
        slack = (norm[active, None] * rest[s + 1][alive][None, :]).astype(kind) if not last else kind(0)
        if not last:
            slack *= kind(1 + 1e-6)
        mine = query_ids[active, None] == ids[alive][None, :]
        low = np.where(mine, -np.inf, scores - slack)
        kth = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k] if len(alive) > k else np.full(len(active), -np.inf)
        # in float32 the bounds round: a unit more is on the safe side
        possible = (scores + slack >= np.maximum(kth, at_least[active])[:, None] - (0 if last else 1)) & ~mine
        stop = possible.sum(1) <= FEW * k if not last else np.ones(len(active), bool)
        for row in np.flatnonzero(stop):
            emit(int(active[row]), alive[possible[row]])
        if last:
            break
        active, scores, possible = active[~stop], scores[~stop], possible[~stop]
        kept = possible.any(0)
        if 2 * kept.sum() < len(alive):
            alive, scores = alive[kept], np.ascontiguousarray(scores[:, kept])
    if not n_segments:
        for place in active.tolist():
            emit(place, alive)
    return done()


def _add(scores: np.ndarray, q: np.ndarray, dims: np.ndarray, slots: np.ndarray, numbers: np.ndarray, alive: np.ndarray, n: int, width: int) -> None:
    """Adds a segment: as a matrix where it is dense, else one posting list (dimension) after another."""
    if len(alive) < n:
        place = np.full(n, -1)
        place[alive] = np.arange(len(alive))
        slots = place[slots]
        keep = slots >= 0
        dims, slots, numbers = dims[keep], slots[keep], numbers[keep]
    if len(dims) * 32 > len(alive) * width:
        m = np.zeros((width, len(alive)), q.dtype)
        m[dims, slots] = numbers
        scores += q @ m
        return
    cuts = np.flatnonzero(np.diff(dims, prepend=-1, append=-1)) if len(dims) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        scores[:, slots[a:b]] += q[:, dims[a], None] * numbers[a:b]


def _block(batch: pa.RecordBatch, i: int) -> Block:
    ids, width, impacts, bounds, dims, slots, numbers = (batch.column(j)[i] for j in range(1, 8))
    lists = [x.values.to_numpy(zero_copy_only=False) for x in (ids, impacts, bounds, dims, slots, numbers)]
    return Block(lists[0], width.as_py(), *lists[1:])


def _merged(best: tuple[np.ndarray, np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of both for each query place, in order of place and rank."""
    place, ids, scores = (np.concatenate(x) for x in zip(best, more))
    order = np.lexsort((ids, ~scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    head = np.flatnonzero(np.diff(place, prepend=-1))
    rank = np.arange(len(place)) - np.repeat(head, np.diff(np.append(head, len(place))))
    return place[rank < k], ids[rank < k], scores[rank < k]


def search(index: DataFrame, asking, k: int) -> DataFrame:
    """FOUND: the k best of each task's blocks for the queries of the broadcast (ids, vectors, least scores). What a block proves bounds the blocks after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, vectors, known = asking.value
        at_least = known.copy()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none for _ in range(0, len(ids), QUERY_BLOCK)]
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch, i)
                for b in range(len(best)):
                    own = slice(b * QUERY_BLOCK, (b + 1) * QUERY_BLOCK)
                    *more, _ = best_of_block(block, ids[own], vectors[own], k, at_least[own])
                    if len(more[0]):
                        best[b] = place, _, scores = _merged(best[b], tuple(more), k)
                        full = np.bincount(place, minlength=len(ids[own])) == k
                        last = np.searchsorted(place, np.arange(len(full)), "right") - 1
                        at_least[own][full] = np.maximum(at_least[own][full], scores[last[full]])
        for b, (place, found, scores) in enumerate(best):
            if len(place):
                yield {"query_id": ids[b * QUERY_BLOCK + place], "vec_id": found, "score": scores}

    return stream_arrow(index, run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries`` (both vec_id, v array<long>)."""
    spark = vectors.sparkSession
    vectors = materialise(vectors.filter("vec_id is not null and v is not null").select("vec_id", "v"), "topk-vectors")
    asked = queries.filter("vec_id is not null and v is not null").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    asked = materialise(asked, "topk-queries")
    index = materialise(build_index(vectors), "topk-index")
    total = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    batches = max(1, -(-(total[0] * max(total[1] or 1, 1)) // BATCH_CELLS))
    first = index.filter(F.col("number") < FIRST)
    many = index.count() > 2 * FIRST

    results = []
    for b in range(batches):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b) if batches > 1 else asked
        rows = own.toArrow().combine_chunks().to_batches()
        if not rows:
            continue
        ids, vectors_ = rows[0].column(0).to_numpy(zero_copy_only=False), matrix(rows[0].column(1))
        at_least = np.full(len(ids), -np.inf)
        if many:
            # a score of k rows of some blocks: the k-th best of all is no less
            bounds = _best(search(first, spark.sparkContext.broadcast((ids, vectors_, at_least)), k), k).filter(F.col("rank") == k).toPandas()
            order = np.argsort(ids)
            at_least[order[np.searchsorted(ids, bounds["query_id"].to_numpy(), sorter=order)]] = bounds["score"].to_numpy()
        results.append(_best(search(index, spark.sparkContext.broadcast((ids, vectors_, at_least)), k), k))
        if batches > 1:
            results[-1] = materialise(results[-1], "topk-found")
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


#: DuckDB SQL for :func:`query`'s rows.
ORACLE = """
with fit as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from fit q join fit c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
