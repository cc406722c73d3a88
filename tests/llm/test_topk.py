"""Exact top-k against brute force: ties, odd vectors, batches, sizes beyond a long, and stops before the last segment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaflow.llm import impact_topk
from chromaflow.llm.common import table

LONGEST = (1 << 63) - 1


def brute(vectors, asked, k=20):
    """(query_id, rank) -> (vec_id, score) in whole numbers without bounds; ``vectors``: (vec_id, list)."""
    out = {}
    for q, v in asked.items():
        scores = [(max(-LONGEST - 1, min(LONGEST, sum(a * b for a, b in zip(v, w)))), i) for i, w in vectors if i != q]
        for rank, (score, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k]):
            out[q, rank + 1] = i, score
    return out


def found(df):
    rows = df.collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("cells, batch", [(1 << 18, 1 << 21), (600, 64)])
def test_top_k(spark, monkeypatch, cells, batch):
    monkeypatch.setattr(impact_topk, "CELLS", cells)
    monkeypatch.setattr(impact_topk, "BATCH_CELLS", batch)
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.15, (300, 16)).astype(np.float32)
    data[50:90] = data[50]
    rows = [(i, [float(v) for v in x], "z") for i, x in enumerate(data)]
    rows += [(300, None, "z"), (320, [float("nan")] * 16, "z"), (340, [None] * 16, "z"), (None, [1.0] * 16, "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    own = vectors.select("vec_id", impact_topk.whole(F.col("embedding")).alias("v"))
    got = found(impact_topk.top_k(own, own.filter("vec_id % 20 = 0"), 20))
    whole = np.floor(data.astype(float) * 64).astype(int).tolist()
    assert got == brute(list(enumerate(whole)), {q: whole[q] for q in range(0, 300, 20)})


def test_odd_vectors(spark):
    """Different widths, repeated ids, empty vectors, few candidates, empty tables."""
    rows = [(0, [1, 2]), (0, [5, -3, 7]), (7, [1, 1]), (9, []), (9, [4, 4, 4, 4]), (11, [0, 0]), (13, [-1])]
    own = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = brute(rows, {0: [1, 2], 9: []})
    assert found(impact_topk.top_k(own, own.filter("vec_id in (0, 9)"), 20)) == want
    assert impact_topk.top_k(own.filter("false"), own, 20).count() == 0 and impact_topk.top_k(own, own.filter("false"), 20).count() == 0


def test_scores_beyond_a_long(spark):
    big = 1 << 62
    rows = [(0, [big, 1]), (1, [big, 5]), (2, [-big, 0]), (3, [3, 0]), (4, [1 << 31, -LONGEST - 1]), (5, [0, 2])]
    own = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert found(impact_topk.top_k(own, own.filter("vec_id in (0, 3, 4)"), 3)) == brute(rows, {0: rows[0][1], 3: [3, 0], 4: rows[4][1]}, 3)
    huge = spark.createDataFrame([(1, [1e300, -1e300])], "vec_id long, e array<double>")
    assert huge.select(impact_topk.whole(F.col("e"))).first()[0] == [LONGEST, -LONGEST - 1]


def skewed(n=3000, width=64, seed=2):
    """Vectors of few large and many small components, in clusters."""
    rng = np.random.default_rng(seed)
    m = rng.integers(-3, 4, (n, width))
    for c in range(40):
        m[c::40, rng.integers(0, width, 3)] += rng.integers(100, 300, 3)
    return m


def test_queries_stop_before_the_last_segment():
    m = skewed()
    ids = np.arange(len(m))
    block = impact_topk.segmented(ids, m)
    asked = np.arange(0, len(m), 20)
    place, found_, scores, steps = impact_topk.best_of_block(block, asked, m[asked], 20, np.full(len(asked), -np.inf))
    want = brute(list(enumerate(m.tolist())), {int(q): m[q].tolist() for q in asked[:20]})
    for p in range(20):
        own = place == p
        assert [want[int(asked[p]), r + 1] for r in range(20)] == list(zip(found_[own].tolist(), scores[own].tolist()))
    assert (steps < len(block.impacts)).mean() > 0.5
    # with a bound from other blocks nothing of a hopeless block is read
    _, none, _, steps = impact_topk.best_of_block(block, asked, m[asked], 20, np.full(len(asked), 1e12))
    assert not len(none) and not steps.any()


def test_postings_cover_the_block():
    m = skewed(200, 16)
    block = impact_topk.segmented(np.arange(200), m)
    assert (block.full() == m).all() and (np.diff(block.bounds) >= 0).all() and block.bounds[-1] == len(block.dims)
    for s, low in enumerate(block.impacts):
        own = slice(block.bounds[s], block.bounds[s + 1])
        size = np.abs(block.numbers[own])
        assert (size >= low).all() and (not s or (size < block.impacts[s - 1]).all()) and (np.diff(block.dims[own]) >= 0).all()


def test_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", impact_topk.whole(F.col("embedding")).alias("v")).filter("v is not null").collect()
    vectors = [(r.vec_id, r.v) for r in rows]
    assert found(impact_topk.query(spark, sf_dir)) == brute(vectors, {i: v for i, v in vectors if i % 20 == 0})
