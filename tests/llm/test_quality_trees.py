"""The lookup tables of the quality model against the sum of the trees they stand for."""

import numpy as np
import pytest

from vigilog.llm.quality import fit


def logit_step(y, total, rows, ridge):
    p = 1 / (1 + np.exp(-total[rows]))
    return (y[rows] - p).sum() / ((p * (1 - p)).sum() + ridge)


def best_cut(y, total, values, rows, cuts, ridge):
    """The cut (rows below it and others) that gains most; the lowest of equals."""
    p = 1 / (1 + np.exp(-total))
    g, h = y - p, p * (1 - p)
    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
    best = (part(rows) + 1e-9, None)
    for cut in cuts:
        low, high = rows[values[rows] < cut], rows[values[rows] >= cut]
        gain = part(low) + part(high)
        if gain > best[0] + 1e-12:
            best = (gain, cut)
    return best[1]


def grow(y, total, values, rows, cuts, depth, ridge):
    """A tree as nested (cut, low, high) with leaf values."""
    cut = best_cut(y, total, values, rows, cuts, ridge) if depth and len(cuts) else None
    if cut is None:
        return logit_step(y, total, rows, ridge)
    low, high = rows[values[rows] < cut], rows[values[rows] >= cut]
    return (cut, grow(y, total, values, low, [c for c in cuts if c < cut], depth - 1, ridge),
            grow(y, total, values, high, [c for c in cuts if c > cut], depth - 1, ridge))


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[1] if x < tree[0] else tree[2]
    return tree


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_equal_the_sum_of_trees(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (300, 3)) + rng.random((300, 3)) / 10
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 6) + (x[:, 1] > 5) * 2))).astype(float)
    rate, ridge, rounds = 0.2, 3.0, 4
    model = fit(x, y, bins=8, n_pairs=0, rounds=rounds, pair_rounds=0, rate=rate, ridge=ridge)
    share = (y.sum() + 1) / (len(y) + 2)
    base = np.log(share / (1 - share))
    total, trees = np.full(len(y), base), []
    for _ in range(rounds):
        for f in range(3):
            tree = grow(y, total, x[:, f], np.arange(len(y)), list(model.cuts[f]), 2, ridge)
            trees.append((f, tree))
            total = total + rate * np.array([walk(tree, v) for v in x[:, f]])
    new = np.concatenate([x, rng.uniform(-1, 14, (200, 3))])
    want = base + np.array([sum(rate * walk(tree, row[f]) for f, tree in trees) for row in new])
    assert np.allclose(model.score(new), 1 / (1 + np.exp(-want)), atol=1e-9)
    assert len(trees) == 12 and sum(isinstance(t, tuple) for _, t in trees) > 6


def test_pairs_add_to_the_tables():
    rng = np.random.default_rng(5)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    plain, paired = fit(x, y, n_pairs=0), fit(x, y, n_pairs=1)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert paired.pairs == [(1, 0)] and right(paired) > 0.9 > right(plain)
    row = x[:1]
    value = paired.pair_tables[0][tuple(int(np.searchsorted(paired.pair_cuts[f], row[0, f], "right")) for f in (1, 0))]
    alone = fit(x, y, n_pairs=0).score(row)
    logit = lambda p: float(np.log(p / (1 - p))[0])
    assert abs(logit(paired.score(row)) - logit(alone) - value) < 1e-9
