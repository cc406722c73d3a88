"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on labelled rows yield paths; each path is a conjunctive rule
over statistics of a text. Logistic regression with a lasso penalty weighs the rules
and drops most; the rest compile into one Spark column expression, so scoring is
one pass: statistics from whole texts (numpy over batches), then native columns.

Training rows: labelled, not held out (crc32 of the id's text modulo 5 is 0), at
most MAX_TRAINING_ROWS rows, those with the smallest hash of doc_id (then of text, where ids
repeat); only their statistics reach the driver. labels, lang, source and doc_id are not inputs.

Defined cases: a null text is empty; an empty text has statistics of 0 and a score
like any other; without labels of both kinds every score is the share of label 1
among them (0.5 if there are none); rows that share a doc_id are scored each; a null
doc_id is not held out; of several labels of an id the largest counts; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow, table, texts
from .repetition import line_repeats

MAX_TRAINING_ROWS = 12_000
THRESHOLD = 0.3
FOLDS = 5
TREES, DEPTH, BINS, RATE, SAMPLE = 40, 3, 24, 0.2, 0.6
PENALTIES = (0.02, 0.008, 0.003, 0.001)
STEPS = 250

STATISTICS = (
    "n_words", "mean_word", "long_words", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "other_marks", "beyond_ascii",
    "same_as_before", "distinct", "in_repeated_4grams", "words_per_line", "repeated_lines",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL, _BANG, _PIPE, _STOP, _COMMA, _OTHER = (_class(x) for x in (b"#*$%&<>=~^+@\\/{}[]_`", b"!", b"|", b".?", b",;:", b"\"'()-"))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each document of a chunk, each per word or a share, without NaN."""
    words = K.Words(buf, offsets)
    n = np.diff(words.first).astype(float)
    some = np.maximum(n, 1.0)
    lead = (buf & 0xC0) != 0x80
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead & words.solid, out=points[1:])
    size = points[words.end] - points[words.start]
    chars = np.maximum(points[offsets[1:]] - points[offsets[:-1]], 1).astype(float)
    counts = lambda table: K.per_doc(table[buf], offsets).astype(float)
    keys = words.keys()
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]).all(1) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((keys[:, 1], keys[:, 0], words.doc))
    own, home = keys[order], words.doc[order]
    first = np.ones(len(keys), bool)
    first[1:] = (own[1:] != own[:-1]).any(1) | (home[1:] != home[:-1])
    hit = K.covered(len(keys), K.repeats_of(keys, words, 4, K.Rolling(np.ascontiguousarray(K.named(keys)[:, 0]))), 4)
    lines = counts(_class(b"\n")) + 1
    repeated = line_repeats(buf, offsets, points)["chars_in_repeated_lines"]
    return {
        "n_words": n,
        "mean_word": K.per_doc(size, words.first) / some,
        "long_words": K.per_doc(size > 16, words.first) / some,
        "upper": counts(_UPPER) / chars,
        "digits": counts(_DIGIT) / chars,
        "symbols": counts(_SYMBOL) / some,
        "bangs": counts(_BANG) / some,
        "pipes": counts(_PIPE) / some,
        "stops": counts(_STOP) / some,
        "commas": counts(_COMMA) / some,
        "other_marks": counts(_OTHER) / some,
        "beyond_ascii": K.per_doc(lead & (buf >= 0x80), offsets) / chars,
        "same_as_before": K.per_doc(again, words.first) / some,
        "distinct": np.bincount(home[first], minlength=words.n_docs) / some,
        "in_repeated_4grams": K.per_doc(hit, words.first) / some,
        "words_per_line": n / lines,
        "repeated_lines": repeated / chars,
    }


def with_statistics(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, ``more`` long columns and STATISTICS of every row."""

    def run(batch):
        parts = [statistics(buf, offsets) for _, _, buf, offsets in K.chunks(batch.column(1 + len(more)))]
        out = {k: np.concatenate([p[k] for p in parts]) for k in STATISTICS}
        return out | {"doc_id": batch.column(0)} | {k: batch.column(1 + i) for i, k in enumerate(more)}

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in more), *(f"{k} double" for k in STATISTICS)])
    return map_arrow(texts(documents, *more), run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


#: One condition of a rule: statistic, is it "greater than", bound.
Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))"""

    bias: float = 0.0
    rules: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for k, above, bound in rule:
                c = F.col(STATISTICS[k])
                holds = holds & ((c > bound) if above else (c <= bound))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * _holds(x, rule)
        return 1 / (1 + np.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'>' if a else '<='} {b:g}" for k, a, b in r) for w, r in self.rules]


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= (x[:, k] > bound) if above else (x[:, k] <= bound)
    return out


def tree_paths(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple[Condition, ...]]:
    """The paths to all nodes of gradient-boosted trees, without repeats."""
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)], axis=1)
    total = np.full(len(y), np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < SAMPLE)
        todo = [((), rows, np.arange(len(y)))]
        while todo:
            path, fit, everyone = todo.pop()
            split = _best_split(binned, bounds, g, h, fit) if len(path) < DEPTH else None
            if split is None:
                total[everyone] += RATE * g[fit].sum() / (h[fit].sum() + 1.0)
                continue
            k, cut = split
            for above in (False, True):
                side = lambda r: r[(binned[r, k] > cut) == above]  # noqa: B023, E731
                longer = (*path, (k, above, float(bounds[k][cut])))
                paths[tuple(sorted(set(longer)))] = None
                todo.append((longer, side(fit), side(everyone)))
    return list(paths)


def _best_split(binned, bounds, g, h, rows) -> tuple[int, int] | None:
    if len(rows) < 20:
        return None
    best, at = 1e-3, None
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for k, own in enumerate(bounds):
        if not len(own):
            continue
        b = binned[rows, k]
        gs, hs, n = (np.cumsum(np.bincount(b, weights=w, minlength=len(own) + 1)) for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - base
        gain[(n < 8) | (n[-1] - n < 8)] = 0
        c = int(np.argmax(gain[:-1]))
        if gain[c] > best:
            best, at = gain[c], (k, c)
    return at


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(bias, weights) by accelerated proximal gradient; columns of ``a`` are 0 or 1 and weigh alike."""
    n = len(y)
    a1 = np.hstack([a, np.ones((n, 1))])
    step = 4 * n / max(np.linalg.norm(a1, 2) ** 2, 1e-9)
    w, v, t = np.zeros(a1.shape[1]), np.zeros(a1.shape[1]), 1.0
    shrink = np.full(a1.shape[1], step * penalty)
    shrink[-1] = 0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a1 @ v)))
        u = v - step * (a1.T @ (p - y)) / n
        u = np.sign(u) * np.maximum(np.abs(u) - shrink, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights from statistics (rows, STATISTICS) and 0/1 labels; the penalty by three folds."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % 3
    loss = np.zeros(len(PENALTIES))
    for f in range(3):
        own, rest = fold != f, fold == f
        paths, a = _matrix(x[own], y[own])
        other = np.stack([_holds(x[rest], r) for r in paths], axis=1).astype(float)
        for i, penalty in enumerate(PENALTIES):
            bias, w = lasso_logistic(a, y[own], penalty)
            z = bias + other @ w
            loss[i] += np.sum(np.logaddexp(0, z) - y[rest] * z)
    paths, a = _matrix(x, y)
    bias, w = lasso_logistic(a, y, PENALTIES[int(np.argmin(loss))])
    return RuleModel(bias, [(float(w[i]), paths[i]) for i in np.flatnonzero(np.abs(w) > 1e-4)])


def _matrix(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    paths, columns, seen = [], [], set()
    for rule in tree_paths(x, y):
        c = _holds(x, rule)
        key = c.tobytes()
        if 5 <= c.sum() <= len(y) - 5 and key not in seen and (~c).tobytes() not in seen:
            seen.add(key)
            paths.append(rule)
            columns.append(c)
    if not paths:
        return [((0, True, -1.0),)], np.ones((len(y), 1))
    return paths, np.stack(columns, axis=1).astype(float)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAINING_ROWS) -> RuleModel:
    """Fits on at most ``most`` labelled rows that are not held out. Of an id's labels the largest counts; rows that repeat an id are rows of their own."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("long").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("place", F.xxhash64("text"))
    # ids may repeat: the bound holds for rows
    got = with_statistics(rows, "y", "place").orderBy(F.xxhash64("doc_id"), "doc_id", "place").limit(most)
    got = got.toPandas().sort_values(["doc_id", *STATISTICS])
    return fit(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float))


def score_quality(documents: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    scored = with_statistics(documents).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, train(documents, table(spark, sf_dir, "labels")))
