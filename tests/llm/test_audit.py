"""The filter audit against all orders applied one by one."""

import random
import re
from itertools import permutations

import pytest
from compare import check, duck

from vigilog.llm import audit, queries
from vigilog.llm.audit import _perhaps_repeated, failures, filter_audit

SF = "/root/testdata/sf0.001"


def brute(rows, labels):
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(x for x, bad in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
            ("D", bool(re.search(r"[#$%&*|]", t))),
            ("E", d is not None and any(o is not None and o < d and (s or "") == t for o, s, _ in rows))) if bad)
        good, toxic = (any(i == d and d is not None and x[k] == 1 for i, *x in labels) for k in (0, 1))
        docs.append((source or "", fails, good, toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, *_ in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                before = sum(x in d[0] for d in own) - len(gone)
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), before, sum(d[0] == x for d in own),
                                          sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return {k: tuple(v) for k, v in out.items()}


def test_query_equals_sql(spark):
    name = "op11_filter_audit"
    problem, n = check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert problem is None and n > 0 and n % 600 == 0


@pytest.mark.parametrize("counters", [16, 0])
def test_orders_against_brute_force(spark, counters):
    rng = random.Random(6)
    word = lambda: rng.choice(["Up", "DOWN", "low", "émile", "x#y", "a|b", "w"]) + str(rng.randint(0, 40))
    rows = [(i, " ".join(word() for _ in range(rng.choice([5, 49, 50, 51, 90]))), rng.choice(["a", "b", None, ""])) for i in range(80)]
    rows += [(100 + i, rows[rng.randint(0, 9)][1], "a") for i in range(60)]  # a hot group
    rows += [(200, None, "c"), (201, "", "c"), (202, None, None), (None, rows[0][1], "a"), (None, None, "a"), (7, rows[7][1], "b"),
             (7, rows[7][1], "b"), (7, rows[8][1], "b"), (203, "y" * 200_000, "d"), (204, "AA\t\n\x0bBB" * 5000, "d"), (0, "zero", "a")]
    rows += [(300 + i, "same", "e") for i in range(5)] + [(None, "only nulls", "f"), (None, "only nulls", "f")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150)] + [(None, 1, 1), (999, 1, 1), (3, 1, 0), (3, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, N int, Mask string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(docs, said, counters=counters).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute(rows, labels) and len(got) == 600 * 7
    assert filter_audit(docs.limit(0), said).count() == 0
    assert filter_audit(docs, said.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_sketch_clears_unique_texts_only(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD", 64)  # tasks hand on many partial sketches
    rows = [(i, f"text {i}") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(100)] + [(9000 + i, "hot") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    again = {r.doc_id: r.again for r in _perhaps_repeated(docs, 16).collect()}
    assert len(again) == len(rows)
    assert all(again[i] and again[5000 + i] for i in range(100)) and all(again[9000 + i] for i in range(500))
    assert sum(again[i] for i in range(100, 3000)) < 60  # few unique texts share all counters


def test_mask_of_each_document(spark):
    rows = [(2, "a b", "s"), (1, "a b", "s"), (3, "$", "s")]
    got = {r.doc_id: r.mask for r in failures(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 1, 2: 17, 3: 9}
