"""Toxic spans by the chain model."""

import itertools
import math
import zlib

import numpy as np

from vigilog.llm.toxicity import ChainModel, Known, score_toxicity, tag, train

WORDS = "stone river cloud green paper light seven north table quiet".split()


def corpus(spark, n=600):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [[str(rng.choice(WORDS)) + str(rng.integers(30)) for _ in range(6)] for _ in range(5)]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words[rng.integers(5)][rng.integers(6)] = str(rng.choice(["vileone", "viletwo", "grubby"]))
        rows.append((i, ". ".join(" ".join(s) for s in words) + "."))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_recursions_equal_enumeration():
    rng = np.random.default_rng(2)
    model = ChainModel({"a": 0}, rng.normal(size=2), rng.normal(size=(2, 2)), float(rng.normal()))
    e = rng.normal(size=5).tolist()
    weight = {}
    for states in itertools.product((0, 1), repeat=5):
        total = states[0] * model.first + sum(x * s for x, s in zip(e, states))
        weight[states] = math.exp(total + sum(model.moves[a, b] for a, b in zip(states, states[1:])))
    z = sum(weight.values())
    toxic, none = model.marginals(e)
    for t in range(5):
        assert abs(toxic[t] - sum(w for s, w in weight.items() if s[t]) / z) < 1e-9
    assert abs(none - math.log(weight[0, 0, 0, 0, 0] / z)) < 1e-9


def test_held_out_documents_and_spans(spark):
    docs, labels = corpus(spark)
    rows = score_toxicity(docs, labels).join(labels, "doc_id").join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    found = {r.text[s.start:s.end] for r in held for s in r.spans}
    assert found & {"vileone", "viletwo", "grubby"} and all(
        set(f.split()) <= {"vileone", "viletwo", "grubby"} for f in found)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame(
        [(1000, None, 1), (1001, "", 1), (1002, "vileone " * 40_000, 1), (1002, "vileone " * 40_000, 1),
         (None, "GRUBBY; vileone.\nviletwo", 1), (1003, "...!?\n\n", 1)], "doc_id long, text string, toxic_score int")
    got = score_toxicity(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), labels).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert [r.predicted for r in got if r.doc_id == 1002] == [1, 1]
    model = train(docs, labels, labels.doc_id >= 0)
    assert tag(odd, model).count() == 6 and tag(odd, model).columns.count("toxic_score") == 1
    none = score_toxicity(odd.select("doc_id", "text"), labels.limit(0)).collect()
    assert len(none) == 6 and {r.score for r in none} == {0.5}
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert Known({"vile*": 3})["VILEst"] == (3,)
