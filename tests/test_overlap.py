"""Overlapping keyword sets against brute force, with frequent words dealt to several tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from vigilog.operators import quality as Q


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECE", 3)
    sets = spark.range(60).select(F.col("id").cast("string").alias("set_id"), F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")), lambda k: ((F.col("id") * 7 + k * k) % 9).cast("string")))).alias("tokens"),
        (F.col("id") * 2).alias("m"))
    rows = [(r.set_id, set(r.tokens), r.m) for r in sets.collect()]
    want = {(a, b, round(len(x & y) / len(x | y), 9), m, n) for a, x, m in rows for b, y, n in rows
            if a < b and len(x & y) / len(x | y) > 0.3}
    found = Q.overlapping_sets(sets, keep=("m",)).select("set_a", "set_b", "jaccard", "m_a", "m_b").collect()
    assert len(found) == len(want) and {(a, b, round(j, 9), m, n) for a, b, j, m, n in found} == want


def random_sets(seed, count, words, longest):
    """Sets of very different lengths, a third of them near copies of others."""
    rng = random.Random(seed)
    sets = []
    for k in range(count):
        own = set(rng.sample(range(words), rng.randint(1, longest))) if k % 3 or not k else set(rng.choice(sets))
        sets.append(sorted(own ^ {rng.randrange(words)} or {0}))
    return [list(s) for s in sorted(set(map(tuple, sets)))]


def alike(sets, threshold):
    sizes = {(a, b): len(set(sets[a]) & set(sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    return {(a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in sizes.items()
            if n / (len(sets[a]) + len(sets[b]) - n) > threshold}


def test_long_sets_whose_words_share_bits(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECE", 11)
    sets = random_sets(2, 240, 700, 300)
    df = spark.createDataFrame([(f"{k:03d}", [f"w{x}" for x in s]) for k, s in enumerate(sets)], "set_id string, tokens array<string>")
    for threshold in (0.3, 0.5):
        got = [(int(r.set_a), int(r.set_b), r.jaccard) for r in Q.overlapping_sets(df, threshold).collect()]
        want = alike(sets, threshold)
        assert len(got) == len(want) > 40 and set(got) == want


def test_groups_and_pairs_are_cut_anywhere(monkeypatch):
    """Groups that span batches, with few rows held and few pairs judged at a time."""
    sets = random_sets(4, 90, 40, 12)
    rows = []
    for k, s in enumerate(sets):  # words are numbered from the rarest on, here by chance
        for at, word in enumerate(s):
            rows += [(word, min(k % 3, q), max(k % 3, q), k % 3, at, f"{k:03d}", s, k * 2) for q in range(3)]
    rows.sort(key=lambda r: r[:4])
    names = ["_word", "_low", "_high", "_piece", "_at", "set_id", "_words", "m"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))
    want = {(f"{a:03d}", f"{b:03d}", j, 2 * a, 2 * b) for a, b, j in alike(sets, 0.3)}
    for held, pairs, size in ((1, 1, 3), (50, 7, 16), (10**6, 10**6, 100)):
        monkeypatch.setattr(Q, "HELD", held)
        monkeypatch.setattr(Q, "PAIRS", pairs)
        monkeypatch.setattr(Q, "WORDS", pairs * 3)
        parts = list(Q._whole_groups(table.to_batches(max_chunksize=size)))
        assert sum(p.num_rows for p in parts) == len(rows)
        got = [tuple(r.values()) for p in parts for b in Q._alike(p, 0.3, ("m",)) for r in b.to_pylist()]
        assert len(got) == len(want) > 40 and set(got) == want


def test_no_pair_is_a_row_of_a_join(spark):
    """A join on frequent words made a row for each candidate: 51 s on 20,000 rules."""
    sets = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "z"])], "set_id string, tokens array<string>")
    plan = Q.overlapping_sets(sets)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Join" not in above and "array_intersect" not in plan
