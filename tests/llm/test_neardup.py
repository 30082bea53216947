"""Near copies against all pairs."""

import random

import pytest

from vigilog.llm import neardup
from vigilog.llm.common import table
from vigilog.llm.components import components
from vigilog.llm.neardup import near_copies, op6_chosen_path

SF = "/root/testdata/sf0.001"


def brute(rows, size, percent):
    """doc_id -> (set size, component) by comparing all pairs of sets that share anything."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets.setdefault(d, []).append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = {d: d for d in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    flat = [(d, s) for d, own in sets.items() for s in own if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((top(a), top(b)))
                label[hi] = lo
    return {d: top(d) for d in sets}


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute(rows, 2, 80)
    got = op6_chosen_path(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    for r in got:
        w = dict(rows)[r.doc_id].encode().lower().split()
        assert r.n_shingles == len(set(zip(w, w[1:]))) or len(w) < 2
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("size", [2, 5])
def test_large_groups_and_odd_rows(spark, size):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for group in range(2):  # near copies of one text each, more than a small node holds
        base = [word() for _ in range(120)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(120)] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, "the same words in every text " + " ".join(word() for _ in range(30))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "ONE"), (1004, "one"), (1005, "one two"),
             (1006, "One\tTwo"), (1007, "x" * 100_000), (1008, "a b " * 30_000), (1009, "b a " * 30_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, rows[0][1], 1)], "doc_id long, text string, label int")
    want = brute(rows, size, 80)
    got = near_copies(docs, size).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_copies(docs.limit(0), size).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    rng = random.Random(4)
    text = {c: " ".join(f"{c}{rng.randint(0, 900)}" for _ in range(40)) for c in "abcxyz"}
    rows = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (9, text["b"]), (9, text["c"]), (12, text["c"]), (20, text["x"]),
            (20, ""), (20, None), (21, text["x"]), (19, text["y"]), (30, text["y"]), (30, text["z"]), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 5, 80)
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.component_id for r in got if r.doc_id == 20} == {20}


@pytest.mark.parametrize("block,pairwise,small", [(1 << 21, 8, 4096), (400, 0, 4096), (3000, 1, 20)])
def test_near_misses_lose_no_link(spark, monkeypatch, block, pairwise, small):
    """Groups of copies with many edits: most pairs are just below the threshold, some above."""
    for name, value in (("BLOCK_SHINGLES", block), ("PAIRWISE", pairwise), ("SMALL", small)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(12)
    rows = []
    for group in range(3):
        base = [f"g{group}w{rng.randint(0, 3000)}" for _ in range(100)]
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randint(1, 14)):
                own[rng.randrange(100)] = rng.choice(["the", "of", f"x{rng.randint(0, 9)}", f"y{rng.random()}"])
            rows.append((len(rows), " ".join(own)))
    want = brute(rows, 2, 80)
    sizes = [list(want.values()).count(c) for c in set(want.values())]
    assert 3 < len(sizes) < 200 and max(sizes) > 5
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.v: r.label for r in got} == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
