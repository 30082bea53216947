"""Ranked search against scores of all documents."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from compare import check, duck

from vigilog.llm import queries, ranked
from vigilog.llm.ranked import NO_ID, Shard, terms_of
from vigilog.llm.ranked import ranked as search

SF = "/root/testdata/sf0.001"


def brute(rows, items, top):
    def split(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    docs = [(d, Counter(split(t))) for d, t in rows]
    n_all = sum(bool(c) for _, c in docs)
    length = sum(sum(c.values()) for _, c in docs)
    asked: dict = {}
    for i, text in items:
        asked.setdefault(i, []).extend(split(text))
    df = Counter(w for _, c in docs for w in c)
    out = set()
    for i, own in asked.items():
        scored = []
        for d, c in docs:
            n = sum(c.values())
            m = 75 + (25 * n * n_all) // length if length else 0
            s = sum(floor(1000 * log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                    for w in own if c[w])
            if s > 0:
                scored.append((-s, NO_ID if d is None else d))
        for rank, (s, d) in enumerate(sorted(scored)[:top], 1):
            out.add((i, rank, None if d == NO_ID else d, -s))
    return out


def test_query_equals_sql(spark):
    name = "op13_range_maxima"
    problem, n = check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert problem is None and n > 0


@pytest.mark.parametrize("shard,terms,at_once", [(1 << 20, 10_000, 24), (150, 12, 3)])
def test_ties_copies_and_odd_rows(spark, monkeypatch, shard, terms, at_once):
    monkeypatch.setattr(ranked, "AT_ONCE", at_once)
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "Éa", "x1", "日本", "q"]) + rng.choice(["", "", "-", str(rng.randint(0, 30))])
    rows = [(rng.randint(0, 10_000), " ".join(word() for _ in range(rng.randint(1, 60)))) for _ in range(300)]
    rows += [(20_000 + i, rows[0][1]) for i in range(120)]  # many equal scores
    rows += [(5, None), (6, ""), (7, "... !"), (None, rows[1][1]), (None, rows[1][1]), (rows[2][0], rows[2][1]), (-3, rows[0][1]),
             (8, "the of " * 30_000), (9, "the" * 50_000), (10, "the\x00of\x7fTHE")]
    items = [(1, "The of THE"), (2, None), (3, "unknownword"), (4, rows[0][1]), (None, "q q q 日本"), (5, "x1-Éa"), (5, "of"),
             (6, "..."), (7, "the " * 50), (8, rows[9][1] + " " + rows[10][1])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, N int, score string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = search(docs, asked, top=20, most_terms=terms, shard_postings=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, items, 20), key=str)
    assert search(docs.limit(0), asked).count() == 0 == search(docs, asked.limit(0)).count()


def test_intervals_are_pruned(monkeypatch):
    """Whole answers though few documents are scored."""
    rng = np.random.default_rng(3)
    n, kinds = 4000, 30
    held = rng.random((n, kinds)) < rng.random(kinds) ** 3
    doc, term = np.nonzero(held)
    tfs = rng.zipf(1.8, len(doc)).clip(max=50)
    weights, rarity = rng.integers(1, 8000, kinds), rng.integers(76, 900, n)
    shard = Shard(np.arange(n) * 2, held.sum(1), term, tfs, weights, rarity)
    looked = []
    highest = shard.highest
    monkeypatch.setattr(shard, "highest", lambda a, b: looked.append(len(a)) or highest(a, b))
    impact = np.zeros((n, kinds), np.int64)
    impact[doc, term] = weights[term] * ((10**9 * tfs) // (1000 * tfs + 12 * rarity[doc]))
    scored = 0
    for _ in range(20):
        own = np.sort(rng.choice(kinds, 4, replace=False))
        times = rng.integers(1, 3, 4)
        looked.clear()
        got = shard.search(own, times, 10, [])
        score = (impact[:, own] * times).sum(1)
        best = sorted((-s, 2 * d) for d, s in enumerate(score.tolist()) if s > 0)[:10]
        assert got == best
        assert shard.search(own, times, 10, [(-(1 << 60), 1)] * 10) == [(-(1 << 60), 1)] * 10
        scored += sum(looked) // 2
    assert scored < 20 * n / 4


def test_range_maxima():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 50)
    terms = np.concatenate([np.sort(rng.choice(12, s, replace=False)) for s in sizes])
    shard = Shard(np.arange(50), sizes, terms, rng.integers(1, 5, len(terms)), np.arange(1, 13), np.full(50, 100))
    for a in range(0, len(terms)):
        end = int(np.searchsorted(shard.key, ((shard.key[a] >> 32) + 1) << 32))
        b = np.arange(a, end + 1)
        got = shard.highest(np.full(len(b), a), b)
        assert got.tolist() == [-1 if x == a else a + int(shard.impact[a:x].argmax()) for x in b]


def test_terms():
    assert terms_of("Don't É_x 日本-9\x7f\x00Z".encode()) == [b"don", b"t", "É".encode(), b"x", "日本".encode(), b"9", b"z"]
