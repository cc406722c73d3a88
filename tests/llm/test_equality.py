"""Equality is that of bytes: colliding names and hashes change no result."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chromaflow.llm import jaccard_join, repetition, rule_quality, substring_dedup
from chromaflow.llm import kernels as K

from .test_llm import TEXTS, brute_components, brute_removal, brute_repetition, frame, words


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


#: Two words that every polynomial modulo 2**64 takes for one.
ONE, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")


def polynomial(word, base=0x9E3779B97F4A7C15):
    total = 0
    for i, c in enumerate(word.encode()):
        total += (c * 2 + 1) * pow(base, i, 1 << 64)
    return total % (1 << 64)


def measured(texts):
    parts = [repetition.measure(b, o) for _, _, b, o in K.chunks(pa.array(texts))]
    return {k: np.concatenate([p[k] for p in parts]).tolist() for k in parts[0]}


def test_words_that_collide_under_polynomials_have_names_of_their_own():
    assert polynomial(ONE) == polynomial(OTHER)
    own = K.Words(*next((b, o) for _, _, b, o in K.chunks(pa.array([f"{ONE} {OTHER} {ONE}"]))))
    first, second, third = own.names().tolist()
    keys = own.keys().tolist()
    assert first == third != second and keys[0] == keys[2] != keys[1]


def test_blocks_name_slices_by_content():
    rng = np.random.default_rng(1)
    values = K.mix(rng.integers(0, 3, 400).astype(np.uint64))
    blocks = K.Blocks(values)
    a = rng.integers(0, 350, 500)
    b = a + rng.integers(1, 50, 500)
    names = {}
    for x, y, name in zip(a.tolist(), b.tolist(), blocks.slices(a, b).tolist()):
        assert names.setdefault(tuple(values[x:y].tolist()), name) == name
    assert len(set(names.values())) == len(names)
    for n in (1, 2, 5, 8, 20):
        assert (blocks.windows(n) == blocks.slices(np.arange(401 - n), np.arange(n, 401))).all()


def brute_coverage(text, n):
    w = words(text)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = {i + k for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for k in range(n)}
    return sum(len(w[i].decode()) for i in hit)


def brute_lines(text):
    lines = [x for x in (text or "").split("\n") if words(x)]
    count = Counter(lines)
    return sum(len(b"".join(words(x)).decode()) for x in lines if count[x] > 1)


@pytest.mark.parametrize("colliding", [False, True])
def test_repetition_measures(monkeypatch, colliding):
    """Also where all rolling hashes collide."""
    if colliding:
        monkeypatch.setattr(K.Rolling, "windows", lambda self, n: np.zeros(max(0, len(self.sums) - n), np.uint64))
    texts = [*TEXTS[:60], f"{ONE} x\n{OTHER} x\n{ONE} x", f"{ONE}\n{OTHER}"]
    got = measured(texts)
    for i, t in enumerate(texts):
        want = brute_repetition(t)
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[:5]
        assert got["chars_in_repeated_lines"][i] == brute_lines(t)
        for n in repetition.NGRAM_LIMITS:
            assert got[f"chars_in_repeated_{n}grams"][i] == brute_coverage(t, n)
    assert got["n_dup_lines"][-2:] == [1, 0]


def test_verdict_follows_the_measures():
    texts = [*TEXTS, " ".join(f"w{i}" for i in range(50)), "\n".join(["one two three four five six"] * 9)]
    m = {k: np.array(v) for k, v in measured(texts).items()}
    failed, kept = repetition.verdict(m)
    for i, t in enumerate(texts):
        chars = sum(len(x.decode()) for x in words(t))
        bad = 100 * brute_lines(t) > 30 * chars or any(100 * brute_coverage(t, n) > most * chars for n, most in ((4, 60), (6, 40), (8, 30), (12, 25)))
        assert failed[i] == brute_repetition(t)[5] and kept[i] == (not failed[i] and not bad)
    assert kept[-2] and not kept[-1]


def brute_statistics(text):
    text = text or ""
    raw = text.encode()
    w = words(text)
    n = len(w)
    some, chars = max(n, 1), max(sum(len(x.decode()) for x in w), 1)
    count = lambda marks: sum(raw.count(bytes([c])) for c in marks.encode())
    grams = Counter(tuple(w[i : i + 4]) for i in range(n - 3))
    hit = {i + k for i in range(n - 3) if grams[tuple(w[i : i + 4])] > 1 for k in range(4)}
    return {
        "n_words": n, "mean_word": sum(len(x.decode()) for x in w) / some, "long_words": sum(len(x.decode()) > 16 for x in w) / some,
        "upper": sum(65 <= c <= 90 for c in raw) / chars, "digits": sum(48 <= c <= 57 for c in raw) / chars, "symbols": count("#*$%&<>=~^+@\\/{}[]_`") / some,
        "bangs": count("!") / some, "pipes": count("|") / some, "stops": count(".?") / some, "commas": count(",;:") / some, "other_marks": count("\"'()-") / some,
        "beyond_ascii": sum(ord(c) > 127 for c in text) / chars, "same_as_before": sum(a == b for a, b in zip(w, w[1:])) / some, "distinct": len(set(w)) / some,
        "in_repeated_4grams": len(hit) / some, "words_per_line": n / (text.count("\n") + 1), "repeated_lines": brute_lines(text) / chars,
    }


def test_statistics_of_quality():
    texts = [t or "" for t in TEXTS] + ["It's (one) - two; THREE!? 4 | 5 # é漢", f"{ONE} {OTHER} {OTHER}"]
    parts = [rule_quality.statistics(b, o) for _, _, b, o in K.chunks(pa.array(texts))]
    for name in rule_quality.STATISTICS:
        got = np.concatenate([p[name] for p in parts])
        assert got == pytest.approx([brute_statistics(t)[name] for t in texts]), name


def test_removal_with_colliding_names(spark):
    """Names of two bits: nearly all stretches and windows collide."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    texts = [" ".join(base), " ".join([*base[:30], ONE, *base[31:60]]), " ".join([*base[:30], OTHER, *base[31:60]]), " ".join(base[40:100])]
    texts += [" ".join(f"w{rng.randrange(6)}" for _ in range(60)) for _ in range(30)] + [" ".join(base[50:90]) + " x"]
    want = brute_removal(texts)
    docs = frame(spark, texts)
    rows = substring_dedup.with_rows(docs)[0]
    for bits in (2, 64):
        found = {r["row"]: r.ranges for r in substring_dedup.repeats(rows, 20, bits).collect()}
        for i, (n, gone, _) in enumerate(want):
            keep = substring_dedup._kept(n, np.array(found.get(i, []), np.int64), 20)
            assert n - int(keep.sum()) == gone, (bits, i)
    for wrong in (1, 5000):
        with pytest.raises(ValueError):
            substring_dedup.removal(docs, wrong)


def test_removal_of_texts_with_colliding_words(spark):
    texts = [" ".join([*(f"a{i}" for i in range(19)), x, *(f"b{i}" for i in range(19))]) for x in (ONE, OTHER, "c", ONE)]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.removal(frame(spark, texts)).collect()}
    assert got == {i: (gone, hashlib.sha256(kept).hexdigest()) for i, (_, gone, kept) in enumerate(brute_removal(texts))}


def test_join_of_texts_with_colliding_words(spark):
    texts = [" ".join([*(f"a{i}" for i in range(12)), *[x] * 3, *(f"b{i}" for i in range(9))]) for x in (ONE, OTHER, "c", ONE.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == brute_components(texts)


def test_frequent_shingles_make_few_candidates(spark):
    """A shingle in thousands of groups: no pairs of all, no task with all of its rows, no link lost."""
    from pyspark.sql import functions as F

    n, match = 3000, 90
    groups = spark.range(n).select(
        F.col("id"), F.lit(30).cast("long").alias("n"),
        F.concat(F.array(F.lit(7).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: 1000 + F.floor(F.col("id") / 2) * 10 + k)).alias("prefix"),
    )
    edges = {(r.a, r.b) for r in jaccard_join.candidate_edges(groups, match, 32).collect()}
    assert edges == {(i, i + 1) for i in range(0, n, 2)}
    same = groups.withColumn("prefix", F.array(*[F.lit(k).cast("long") for k in range(5)]))
    chain = jaccard_join.candidate_edges(same, match, 32).collect()
    assert len(chain) == n - 1 and {r.b for r in chain} == set(range(1, n))


def passages(n=60):
    """Texts of the same words, each in its own order, around a passage that all share; and near copies of some."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(150)]
    texts = []
    for k in range(n):
        own = [f"w{k}" for k in range(250)]
        rng.shuffle(own)
        texts.append(own[:125] + passage + own[125:])
        if k % 6 == 0:
            other = list(texts[-1])
            for _ in range(rng.randint(1, 6)):
                other[rng.randrange(400)] = f"w{rng.randrange(250)}"
            texts.append(other)
    return [" ".join(x) for x in texts]


@pytest.mark.parametrize("match, size", [(90, 3), (80, 5)])
def test_frequent_shingles_make_few_rows(spark, match, size, monkeypatch):
    """No table grows with the product of a prefix and its frequent shingles, and no link is lost."""
    texts, written = passages(), {}

    def counted(df, name, real=jaccard_join.materialise):
        out = real(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    monkeypatch.setattr(jaccard_join, "MOST_BLOCK", 64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(frame(spark, texts), match, size).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, match, size)
    prefixes = sum(jaccard_join.prefix_length(n, match) + 1 for n, _ in got.values())
    assert max(rows for name, rows in written.items() if name != "bucket-pairs") <= 4 * prefixes, (prefixes, written)


@pytest.mark.parametrize("match", [50, 80, 90])
def test_matching_sets_have_parts_in_common(match):
    """Sets that match share a part in each band of both, as many as the smaller set's number says."""
    rng = np.random.default_rng(match)
    for _ in range(400):
        n = int(rng.integers(2, 150))
        both = K.mix(rng.integers(0, 1 << 60, n).astype(np.uint64))
        most = (100 - match) * n // (100 + match) + 1
        gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        one, other = np.unique(both), np.unique(np.concatenate([both[gone:], K.mix(rng.integers(1 << 61, 1 << 62, new).astype(np.uint64))]))
        common = len(np.intersect1d(one, other))
        if 100 * common < match * (len(one) + len(other) - common) or common == max(len(one), len(other)):
            continue
        bands = set(jaccard_join.size_bands(len(one), match)) & set(jaccard_join.size_bands(len(other), match))
        low, most = max(bands)
        (a, least_a), (b, least_b) = (jaccard_join.parts_of_set(x, low, most) for x in (one, other))
        assert len(one) + len(other) - 2 * common <= most
        assert len(np.intersect1d(a, b)) >= max(least_a, least_b) >= 1


def test_intermediate_folders_go_when_a_result_stands(spark):
    """After a stage only what its frame reads is left, and the session's settings are as before."""
    from chromaflow.llm import common, mixing

    texts = [" ".join(f"w{(i // 2) * 7 + k}" for k in range(60)) + f" x{i}" for i in range(12)]
    docs = frame(spark, texts)
    for stage, left in ((lambda d: jaccard_join.keep_one(d, 80, 5), 1), (substring_dedup.strip_repeats, 1), (mixing.mixed_documents, 1)):
        before, setting = len(common._written), spark.conf.get(common.CLEANUP)
        out = stage(docs)
        assert len(common._written) - before <= left and spark.conf.get(common.CLEANUP) == setting
        assert out.count() > 0


def test_few_ids_move_no_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard_join.keep_one(frame(spark, ["a b c d e f", "g h i j k l"]), 80, 5)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forest_passes_over_copies():
    """Members that are linked with one compared before are compared once, and the components are those of all pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(80)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own))
    batch = pa.record_batch({"island": [0] * 60, "low": [0] * 60, "high": [0] * 60, "row": list(range(60)), "text": texts})
    links = [x for out in jaccard_join._forest(80, 3)(iter([batch])) for x in zip(out["a"], out["b"])]
    comp = list(range(60))
    for a, b in links:
        x, y = sorted((comp[a], comp[b]))
        comp = [x if c == y else c for c in comp]
    assert comp == [c for _, c in brute_components(texts, 80, 3)]
