"""Palette search on one image's histogram: recursive weighted partitioning, then weighted k-means.

The histogram is already aggregated in Spark, so an image is a group of at most a few
million weighted colours; the search is a sequence of dependent steps and runs as one
grouped numpy function per image.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PALETTE = "image_id long, idx long, qa double, qr double, qg double, qb double, popularity double, error double"


@dataclass(frozen=True)
class Search:
    """Budgets: colours, largest and wanted error, trials, k-means steps and their limit, bits that the output loses."""

    colours: int = 256
    most_error: float = 1e20
    target_error: float = 0.0
    trials: int = 20
    iterations: int = 12
    limit: float = 2.0**-19
    output_bits: int = 0

    @classmethod
    def of_speed(cls, speed: int, colours: int = 256, most_error: float = 1e20, target_error: float = 0.0, output_bits: int = 0) -> Search:
        s = min(speed, 10)
        i = max(8 - s, 0)
        return cls(colours, most_error, target_error, max(56 - 9 * s, 0), i + i * i // 2, 2.0 ** -(23 - s), output_bits)

    def for_items(self, n: int) -> Search:
        """The budgets of a histogram of ``n`` entries: fewer trials and steps where it is large, errors no finer than the output."""
        trials, iterations = self.trials, self.iterations
        for limit in (5_000, 25_000, 50_000, 100_000):
            if n > limit:
                trials, iterations = -(-trials * 3 // 4), -(-iterations * 3 // 4)
        most = self.most_error if self.most_error >= NO_LIMIT else self.most_error * (0.33 if n <= self.colours else 1.0)
        target = min(max(self.target_error, (2.0**self.output_bits / 1024.0) ** 2), most)
        return replace(self, trials=trials, iterations=iterations, limit=self.limit * (2.0 if n > 100_000 else 1.0), most_error=most, target_error=target)


def differences(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Colour difference of each of ``one`` (n, 4: a r g b) to each of ``other`` (k, 4)."""
    gap = one[:, None, :] - other[None, :, :]
    da = -gap[:, :, :1]
    rgb = gap[:, :, 1:]
    return np.maximum(rgb**2, (rgb + da) ** 2).sum(2)


def nearest(items: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, error) of the nearest palette entry of each item, in blocks of bounded size."""
    idx, err = np.zeros(len(items), np.int64), np.zeros(len(items))
    for a in range(0, len(items), 512):
        own = items[a : a + 512]
        da = palette[None, :, 0] - own[:, 0, None]
        d = 0.0
        for c in (1, 2, 3):
            black = own[:, c, None] - palette[None, :, c]
            white = black + da
            d = d + np.maximum(black * black, white * white)
        best = d.argmin(1)
        idx[a : a + 512], err[a : a + 512] = best, d[np.arange(len(own)), best]
    return idx, err


#: The least error a colour is allowed in the search, as errors of qualities 20, 1 and 51 in internal units.
_Q20, _Q1, _Q51 = (0.45 * (max(0.016 / (0.001 + q) - 0.001, 0.0) + 2.5 / (210.0 + q) ** 1.2 * (100.1 - q) / 100.0) for q in (20, 1, 51))
NO_LIMIT = 1e20


class _Box:
    """Some items: their weight, mean, spread by channel and worst error; an empty box is a free place of the palette."""

    __slots__ = ("rows", "weight", "mean", "variance", "worst", "score", "error")

    def __init__(self, items: np.ndarray, weight: np.ndarray, rows: np.ndarray):
        own, w = items[rows], weight[rows]
        self.rows, self.error = rows, None
        self.weight = float(w.sum())
        self.mean = w @ own / self.weight if self.weight > 0 else np.zeros(4)
        self.variance = w @ (own - self.mean) ** 2
        self.worst = float(differences(own, self.mean[None])[:, 0].max(initial=0.0))
        self.score = self.weight * float(self.variance.sum()) if len(rows) > 1 else -1.0

    def total_error(self, items: np.ndarray, perceptual: np.ndarray) -> float:
        if self.error is None:
            self.error = float(differences(items[self.rows], self.mean[None])[:, 0] @ perceptual[self.rows])
        return self.error

    def halves(self, items: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items before and from the middle of their force, in descending order of the channel that varies most, then of the others, each cut to 16 bits."""
        axes = np.argsort(-self.variance, kind="stable")
        own = items[self.rows]
        cut = lambda v: np.clip(v * 65535.0, 0, 65535).astype(np.int64)
        key = (cut(own[:, axes[0]]) << 16) | cut(own[:, axes[2]] + own[:, axes[1]] / 2 + own[:, axes[3]] / 4)
        order = np.argsort(key, kind="stable")
        middle = own[order[len(order) // 2]]
        force = np.sqrt(np.sqrt(differences(own, middle[None])[:, 0]) * (2 + weight[self.rows]))
        order = np.argsort(-key, kind="stable")
        upto = np.cumsum(force[order])
        at = max(int(np.searchsorted(upto, upto[-1] / 2)), 1)
        return self.rows[order[:at]], self.rows[order[at:]]


def clusters(items: np.ndarray) -> np.ndarray:
    """The number of each item's cluster: the top bits of its bytes r, g, b, a."""
    alpha = items[:, 0] / 0.625
    clear = items[:, 0] <= 0.625 / 255
    out = (alpha * 256 >= 128) & ~clear
    for c, share in ((3, 0.45), (2, 1.0), (1, 0.5)):
        value = np.maximum(items[:, c] / share / np.where(clear, 1.0, alpha), 0.0) ** (0.45455 / 0.57) * 256
        out = out + (1 << (4 - c)) * ((value >= 128) & ~clear)
    return out.astype(np.int64)


def median_cut(
    items: np.ndarray, weight: np.ndarray, colours: int, target: float = 0.0, most: float = 0.0, perceptual: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(palette, popularity): the box that spreads most is halved until there are enough, or all of the error is below ``target``.

    Few clusters of top bits are boxes to begin with. A box whose worst error exceeds an allowance counts more; the
    allowance grows from ``most`` with the share of boxes made.
    """
    perceptual = weight if perceptual is None else perceptual
    home = clusters(items)
    names = np.unique(home)
    boxes = [_Box(items, weight, np.flatnonzero(home == n)) for n in names] if len(names) <= colours // 3 else [_Box(items, weight, np.arange(len(items)))]
    most, total = max(most, _Q20), target * float(perceptual.sum())
    while len(boxes) < colours:
        allowed = most * (1 + 16 * len(boxes) / colours)
        scores = [b.score * (b.worst / allowed if b.worst > allowed else 1.0) for b in boxes]
        k = len(scores) - 1 - int(np.argmax(scores[::-1]))
        if scores[k] < 0:
            break
        halves = boxes[k].halves(items, weight)
        boxes[k] = boxes[-1]
        boxes[-1:] = [_Box(items, weight, rows) for rows in halves]
        if np.isfinite(total) and _reached(boxes, items, perceptual, total):
            break
    palette = np.stack([items[b.rows][differences(items[b.rows], b.mean[None])[:, 0].argmin()] if len(b.rows) > 2 else b.mean for b in boxes])
    return palette, np.array([perceptual[b.rows].sum() for b in boxes])


def _reached(boxes: list[_Box], items: np.ndarray, perceptual: np.ndarray, total: float) -> bool:
    """Whether the errors of all boxes stay below ``total``; those known are summed first."""
    error = sum(b.error for b in boxes if b.error is not None)
    for b in boxes:
        if error > total:
            return False
        if b.error is None:
            error += b.total_error(items, perceptual)
    return error <= total


def kmeans_step(items: np.ndarray, perceptual: np.ndarray, adapted: np.ndarray, palette: np.ndarray, reflect: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(palette, popularity, adapted weights, mean error) after one step.

    With ``reflect``, an item's error is that of its colour reflected away from its entry, and items gain weight by it.
    Entries without alpha stay where they are; places without items go to the items that fit worst, one after another.
    """
    idx, err = nearest(items, palette)
    if reflect:
        err = nearest(2 * items - palette[idx], palette)[1]
        adapted = (2 * adapted + perceptual) * (0.5 + err)
    error = float(err @ perceptual / max(float(perceptual.sum()), 1e-9))
    popularity = np.bincount(idx, weights=adapted, minlength=len(palette))
    sums = np.stack([np.bincount(idx, weights=items[:, c] * adapted, minlength=len(palette)) for c in range(4)], 1)
    moves = (popularity > 0) & (palette[:, 0] != 0)
    palette = np.where(moves[:, None], sums / np.where(moves, popularity, 1.0)[:, None], palette)
    free = np.flatnonzero(popularity <= 0)
    if len(free):
        idx, err = nearest(items, palette)
        for place in free:
            worst = int(err.argmax())
            if err[worst] <= 0:
                break
            palette[place], popularity[place] = items[worst], adapted[worst]
            # what was nearest to the old entry looks for another, all others compare with the new one
            old = np.flatnonzero(idx == place)
            if len(old):
                idx[old], err[old] = nearest(items[old], palette)
            now = differences(items, palette[place][None])[:, 0]
            nearer = now < err
            idx[nearer], err[nearer] = place, now[nearer]
    return palette, popularity, adapted, error


def kmeans(
    items: np.ndarray, weight: np.ndarray, palette: np.ndarray, steps: int, limit: float, most: float = NO_LIMIT, before: float | None = None, adapted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, float]:
    """(palette, popularity, mean error) after at most ``steps`` steps; they end when the error hardly moves and count double while it is far beyond ``most``."""
    adapted = weight if adapted is None else adapted
    popularity, done = None, 0
    while done < steps:
        palette, popularity, _, error = kmeans_step(items, weight, adapted, palette)
        if before is not None and abs(before - error) < limit:
            break
        before, done = error, done + (2 if error > 1.5 * most else 1)
    idx, err = nearest(items, palette)
    if popularity is None:
        popularity = np.bincount(idx, weights=weight, minlength=len(palette))
    return palette, popularity, float(err @ weight / weight.sum())


def best_palette(items: np.ndarray, weight: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, float]:
    """Median cut with feedback: in trials, items that fit badly weigh more in the next cut; the best palette is refined by k-means.

    A trial that meets the target asks for less error or fewer colours; each that brings nothing costs more trials than the last.
    The error is the mean error of the palette that is returned.
    """
    if len(items) <= search.colours and search.target_error <= 0:
        return items, weight, 0.0
    search = search.for_items(len(items))
    target, colours, left = search.target_error, search.colours, search.trials
    overshoot, fails = 1.05 if left > 0 else 1.0, 0
    adapted, best, error = weight.copy(), None, None
    while True:
        allowed = 1.2 * max(target, error if error is not None else _Q1, _Q51)
        palette, popularity = median_cut(items, adapted, colours, target * overshoot, allowed, weight)
        if left <= 0:
            best = palette
            break
        reflect = best is not None or target <= 0
        palette, popularity, adapted, now = kmeans_step(items, weight, adapted, palette, reflect)
        if best is None or now < error or (now <= target and len(palette) < colours):
            if 0 < now < target:
                overshoot = min(overshoot * 1.25, target / now)
            best, error, fails = palette, now, 0
            colours = min(colours, len(palette) + 1)
            left -= 1
        else:
            fails, overshoot = fails + 1, 1.0
            left -= 5 + fails
        if left <= 0:
            break
    steps = search.iterations
    if steps == 0 and error is None and search.most_error < NO_LIMIT:
        steps = 1
    return kmeans(items, weight, best, steps, search.limit, search.most_error, error, adapted)


def search_palettes(histogram: DataFrame, search: Search, refine: bool = True) -> DataFrame:
    """One palette per image from weighted items (image_id, pa, pr, pg, pb, weight): median cut alone, or the whole search."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pa", "pr", "pg", "pb"], kind="stable")
        items, weight = pdf[["pa", "pr", "pg", "pb"]].to_numpy(float), pdf["weight"].to_numpy(float)
        if refine:
            palette, popularity, error = best_palette(items, weight, search)
        else:
            palette, popularity = median_cut(items, weight, search.colours, search.target_error)
            error = float((nearest(items, palette)[1] * weight).sum() / weight.sum())
        out = pd.DataFrame(palette, columns=["qa", "qr", "qg", "qb"])
        out["popularity"], out["error"] = popularity, error
        out = out.iloc[np.lexsort((-popularity, palette[:, 0] >= 0.625 * 254.5 / 255))].reset_index(drop=True)
        out.insert(0, "idx", np.arange(len(out)))
        out.insert(0, "image_id", int(pdf["image_id"].iloc[0]))
        return out

    return histogram.groupBy("image_id").applyInPandas(run, PALETTE)
