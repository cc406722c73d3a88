"""The palette search, the dither map and the diffusion against plain models."""

import numpy as np
import pytest

from chromaflow.operators import dither, palette


def gap(x, y):
    """Colour difference of two (a, r, g, b): in each channel the larger of that on black and that on white."""
    da = y[0] - x[0]
    return sum(max((x[c] - y[c]) ** 2, (x[c] - y[c] + da) ** 2) for c in (1, 2, 3))


def plain_step(items, perceptual, adapted, entries, reflect):
    adapted, entries = list(adapted), [list(e) for e in entries]
    weights, sums, total, homes = [0.0] * len(entries), [[0.0] * 4 for _ in entries], 0.0, []
    shown = [list(e) for e in entries]
    for i, item in enumerate(items):
        k = min(range(len(shown)), key=lambda j: gap(item, shown[j]))
        error = gap(item, shown[k])
        if reflect:
            away = [2 * item[c] - shown[k][c] for c in range(4)]
            error = min(gap(away, e) for e in shown)
            adapted[i] = (2 * adapted[i] + perceptual[i]) * (0.5 + error)
        homes.append(k)
        total += error * perceptual[i]
        weights[k] += adapted[i]
        for c in range(4):
            sums[k][c] += item[c] * adapted[i]
    for k in range(len(entries)):
        if weights[k] and entries[k][0] != 0:
            entries[k] = [sums[k][c] / weights[k] for c in range(4)]
    for k in range(len(entries)):
        if not weights[k]:
            errors = [min(gap(item, e) for e in entries) for item in items]
            worst = max(range(len(items)), key=lambda i: errors[i])
            if errors[worst] > 0:
                entries[k], weights[k] = list(items[worst]), adapted[worst]
    return entries, weights, adapted, total / sum(perceptual)


@pytest.mark.parametrize("seed", range(12))
def test_kmeans_step_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    items, weight = rng.random((40, 4)) * 0.6, rng.random(40) + 0.1
    adapted, entries = weight * rng.random(40) + 0.05, rng.random((9, 4)) * 0.6
    entries[3] = entries[4] = 5.0  # far from all items: free places
    entries[5] = 0.0  # without alpha
    for reflect in (False, True):
        got = palette.kmeans_step(items, weight, adapted, entries, reflect)
        want = plain_step(items.tolist(), weight.tolist(), adapted.tolist(), entries.tolist(), reflect)
        for a, b in zip(got, want):
            assert np.allclose(a, b)


def plain_cut(items, weight, colours, allowed):
    """Median cut without a target, box by box."""
    clamp = lambda v: int(min(max(v * 65535.0, 0), 65535))

    def box(rows):
        w = sum(weight[i] for i in rows)
        mean = [sum(items[i][c] * weight[i] for i in rows) / w for c in range(4)]
        variance = [sum((items[i][c] - mean[c]) ** 2 * weight[i] for i in rows) for c in range(4)]
        return rows, w, mean, variance, max(gap(mean, items[i]) for i in rows)

    boxes = [box(list(range(len(items))))]
    while len(boxes) < colours:
        most = allowed * (1 + 16 * len(boxes) / colours)
        scores = [(w * sum(v) * (worst / most if worst > most else 1) if len(rows) > 1 else -1) for rows, w, _, v, worst in boxes]
        k = max(range(len(boxes)), key=lambda i: (scores[i], i))
        if scores[k] < 0:
            break
        rows, _, _, variance, _ = boxes[k]
        axes = sorted(range(4), key=lambda c: -variance[c])
        key = {i: (clamp(items[i][axes[0]]) << 16) | clamp(items[i][axes[2]] + items[i][axes[1]] / 2 + items[i][axes[3]] / 4) for i in rows}
        middle = items[sorted(rows, key=lambda i: key[i])[len(rows) // 2]]
        force = {i: (gap(middle, items[i]) ** 0.5 * (2 + weight[i])) ** 0.5 for i in rows}
        order = sorted(rows, key=lambda i: -key[i])
        half, upto, at = sum(force.values()) / 2, 0.0, 0
        while at < len(order) and upto + force[order[at]] < half:
            upto += force[order[at]]
            at += 1
        at = max(at, 1)
        boxes[k] = boxes[-1]
        boxes.pop()
        boxes += [box(order[:at]), box(order[at:])]
    return [min((items[i] for i in rows), key=lambda x: gap(mean, x)) if len(rows) > 2 else mean for rows, _, mean, _, _ in boxes]


@pytest.mark.parametrize("seed", range(8))
def test_median_cut_is_the_plain_one(seed):
    """Items in all sixteen clusters, so that one box is the beginning."""
    rng = np.random.default_rng(seed)
    items, weight = rng.random((120, 4)) * np.array([0.625, 0.5, 1.0, 0.45]), rng.random(120) + 0.1
    got, popularity = palette.median_cut(items, weight, 12, float("inf"), 0.02)
    want = plain_cut(items.tolist(), weight.tolist(), 12, max(0.02, palette._Q20))
    assert np.allclose(sorted(got.tolist()), sorted(want)) and abs(popularity.sum() - weight.sum()) < 1e-9


def test_few_clusters_are_boxes_to_begin_with():
    dark, light = np.full((5, 4), 0.01) + np.arange(5)[:, None] * 1e-3, np.full((5, 4), 0.44) - np.arange(5)[:, None] * 1e-3
    dark[:, 0] = light[:, 0] = 0.625
    items = np.vstack([dark, light])
    assert len(np.unique(palette.clusters(items))) == 2
    got, _ = palette.median_cut(items, np.ones(10), 6, 1e9)
    assert len(got) == 3  # two clusters, one split, and the target is reached


def test_palette_has_at_most_its_colours():
    rng = np.random.default_rng(3)
    items, weight = rng.random((500, 4)) * 0.6, rng.random(500) + 0.1
    for colours in (2, 7, 64):
        for speed in (1, 4, 10):
            got, popularity, error = palette.best_palette(items, weight, palette.Search.of_speed(speed, colours))
            assert len(got) <= colours and len(popularity) == len(got) and error > 0


def test_targets_scale_with_the_histogram():
    small = palette.Search(colours=256, most_error=0.3, target_error=0.2).for_items(100)
    assert (small.most_error, small.target_error) == (pytest.approx(0.099), pytest.approx(0.099))
    large = palette.Search(colours=256, most_error=0.3, target_error=0.2).for_items(1000)
    assert (large.most_error, large.target_error) == (0.3, 0.2)
    assert palette.Search(output_bits=2).for_items(1000).target_error == (4 / 1024) ** 2
    assert palette.Search(limit=0.5).for_items(200_000).limit == 1.0


def test_no_refinement_without_steps():
    rng = np.random.default_rng(5)
    items, weight, entries = rng.random((50, 4)), np.ones(50), rng.random((6, 4))
    same, _, _ = palette.kmeans(items, weight, entries, 0, 0.0)
    assert (same == entries).all()


def plain_strengths(idx, edge):
    h, w = len(idx), len(idx[0])
    out = [list(row) for row in edge]
    for y in range(h):
        began = 0
        for x in range(1, w):
            if idx[y][x] != idx[y][began] or x == w - 1:
                n = 10 * (x - began)
                for i in range(began, x):
                    n += 15 * (y > 0 and idx[y - 1][i] == idx[y][began]) + 15 * (y + 1 < h and idx[y + 1][i] == idx[y][began])
                for i in range(began, x + 1):
                    out[y][i] = int((out[y][i] + 128) * (255 / 383) * (1 - 20 / (20 + n)))
                began = x
    return out


@pytest.mark.parametrize("seed", range(20))
def test_dither_map_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    idx, edge = rng.integers(0, 3, (7, int(rng.integers(2, 12)))), rng.integers(0, 256, (7, 12))
    edge = edge[:, : idx.shape[1]]
    assert dither.run_strengths(idx, edge).tolist() == plain_strengths(idx.tolist(), edge.tolist())


def test_diffusion_values():
    assert dither.base_level(1.0) == 15 / 16 and dither.base_level(0.5) == pytest.approx(0.75 * 15 / 16) and dither.base_level(0) == 0
    assert dither.most_error(None) == pytest.approx(max(2.4 * dither._Q80, dither._Q35)) and dither.most_error(1.0) == 2.4
    small = np.array([0.001, 0.001, 0.001, 0.001])
    assert (dither._pushed(np.full(4, 0.5), small, 1.0) == 0.5).all()
    # red, green and blue move by one ratio, alpha alone is clamped
    pushed = dither._pushed(np.array([0.6, 0.5, 1.0, 0.2]), np.array([0.7, 0.1, 0.4, 0.1]), 10.0)
    assert pushed == pytest.approx([1.0, 0.5 + 0.1 * 0.25, 1.1, 0.2 + 0.1 * 0.25])
