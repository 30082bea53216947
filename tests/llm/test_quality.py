"""The additive quality model."""

import zlib

import numpy as np

from vigilog.llm.quality import FEATURES, fit, op1_quality_additive, score_quality, shape

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op1_quality_additive(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_every_row_is_scored(spark):
    docs = spark.createDataFrame(
        [(1, "Plain words here.", "a"), (1, "Plain words here.", "a"), (2, None, "b"), (None, "", "c"),
         (3, "w " * 50_000, "d"), (4, "###", "e")], "doc_id long, text string, shape string")
    labels = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (4, 0, 5), (2, None, 5), (None, 1, 5)],
                                   "doc_id long, quality int, score int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert len({r.score for r in score_quality(docs, labels.limit(0)).collect()}) == 1
    assert score_quality(docs.limit(0), labels).count() == 0


def test_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000], rounds=20)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    z = (x[:, 3] + x[:, 5] > 1).astype(float)
    assert np.mean((fit(x[:3000], z[:3000]).score(x[3000:]) > 0.5) == z[3000:]) > 0.9


def test_shape_of_odd_texts():
    rows = shape([b"", b"\n\n", b"aB1 .\n", "é".encode()])
    assert rows.shape == (4, len(FEATURES)) and np.isfinite(rows).all()
