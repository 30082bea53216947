"""Nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from vigilog.llm.nearest import fit, hilbert, nearest, op5_hilbert_windows

SF = "/root/testdata/sf0.1"


def exact(rows, asked, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero([a in asked for a in ids]):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(rows, {i for i, _ in rows if i % 100 == 0})
    got = {}
    for r in op5_hilbert_windows(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(np.linalg.norm(x[q] - x[v]) - s) < 1e-12 for _, v, s in found)


def test_windows_are_narrow_where_the_data_allow_it():
    rng = np.random.default_rng(3)
    line = np.outer(rng.random(3000), rng.normal(size=16))
    assert fit(line).share < 0.02 < fit(rng.normal(size=(3000, 16))).share


def test_clusters_with_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))[rng.integers(60, size=6000)] * 10 + rng.normal(size=(6000, 8)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 500 == 0).collect()
    want = exact(rows, set(range(0, 6000, 500)))
    hits = sum((r.id, ) in {(v,) for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 120 and hits >= 0.95 * 120


def test_ties_repeats_and_odd_rows(spark):
    hot = [1.0, 2.0]
    rows = [(i, hot) for i in range(40)] + [(100, [1.0, 3.0]), (101, [1.0, 1.0]), (200, None), (300, []), (400, [0.0, 0.0]),
                                            (500, [math.nan, 1.0]), (600, [None, 1.0]), (700, [1.0, math.inf]), (None, hot),
                                            (3, hot), (800, [1.0]), (900, [2.0]), (41, [-0.0, 5.0]), (1000, [0.0, 5.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    got = {}
    for r in nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert sorted(got) == [0, 100, 800, 900, 1000]
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11)) and {s for _, _, s in got[0]} == {0.0}
    assert [v for _, v, _ in sorted(got[100])] == list(range(10))
    assert sorted(got[800]) == [(1, 900, 1.0)] and sorted(got[900]) == [(1, 800, 1.0)]
    assert sorted(got[1000])[0] == (1, 41, 0.0)
    assert nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0
