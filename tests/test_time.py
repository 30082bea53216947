"""Sequences, throttle, dedup and pieces against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.operators.dedup import dedup_gap, throttle
from vigilog.operators.hotkeys import time_pieces
from vigilog.operators.sequence import match_sequences
from vigilog.sources.events import retain_newest

PATTERNS = {"ab": (40, "ab"), "aaa": (90, "aaa"), "abca": (300, "abca")}


def rows(n=1500, hot=0.6, seed=1):
    """Events of a few keys, one of which holds most rows; many share a second."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < hot else f"k{rng.randrange(5)}", rng.randrange(4000) * 1_000_000,
             rng.choice("aabcx")) for i in range(n)]


def greedy(data, cap, lock):
    out = set()
    for key in {r[1] for r in data}:
        mine = sorted((us, i, kind) for i, k, us, kind in data if k == key)
        last = {}
        for at, (us, i, _) in enumerate(mine):
            for name, (width, letters) in PATTERNS.items():
                if name in last and us - last[name] < lock * 1_000_000:
                    continue
                window = [r for r in mine[max(0, at - cap + 1):at + 1] if r[0] >= us - width * 1_000_000]
                taken = []
                for r in window:
                    if len(taken) < len(letters) and r[2] == letters[len(taken)]:
                        taken.append(r[1])
                if len(taken) == len(letters):
                    last[name] = us
                    out.add((name, key, us, i, window[0][0], tuple(taken)))
    return out


@pytest.mark.parametrize("cap, lock, per_piece", [(500, 30, 200_000), (12, 30, 50), (7, 200, 20)])
def test_sequences(spark, cap, lock, per_piece):
    data = rows()
    df = spark.createDataFrame(data, "id bigint, key string, us bigint, kind string")
    chains = [(n, w, [F.col("kind") == c for c in letters]) for n, (w, letters) in PATTERNS.items()]
    got = match_sequences(df, ["key"], "us", ["id"], chains, cap, lock, rows_per_piece=per_piece).collect()
    assert {(r.chain_id, r.key, r.us, r.id, r.first_us, tuple(s.id for s in r.steps)) for r in got} == greedy(
        data, cap, lock)


@pytest.mark.parametrize("limit", [100_000, 200, 5])
def test_throttle(spark, limit):
    rng = random.Random(2)
    data = [(i, f"k{i % 2}", rng.randrange(20_000) * 1_000_000 + rng.randrange(3)) for i in range(4000)]
    df = spark.createDataFrame(data, "id bigint, key string, us bigint")
    got = {(r.key, r.us, r.id) for r in throttle(df, ["key"], "us", 7, ["id"], large_island=limit).collect()}
    want = set()
    for key in ("k0", "k1"):
        last = None
        for us, i in sorted((us, i) for i, k, us in data if k == key):
            if last is None or us - last >= 7_000_000:
                last = us
                want.add((key, us, i))
    assert got == want


def test_dedup_boundary(spark):
    hits = [(1, 0), (2, 299_999_999), (3, 599_999_999), (4, 900_000_000), (5, 899_999_999)]
    df = spark.createDataFrame([("f", u, i) for i, u in hits], "key string, us bigint, id int")
    got = sorted((r.id, r.hit_count, r.first_us, r.last_us) for r in dedup_gap(df, ["key"], "us", 300, ["id"]).collect())
    # exactly 300 s after the previous hit opens a new alert
    assert got == [(1, 2, 0, 299_999_999), (3, 1, 599_999_999, 599_999_999), (5, 2, 899_999_999, 900_000_000)]


def test_pieces_cover_every_row_once_and_bound_the_overlap(spark):
    data = rows(3000)
    df = spark.createDataFrame(data, "id bigint, key string, us bigint, kind string")
    got = time_pieces(df, ["key"], "us", 10, rows_per_piece=100, slot_seconds=5)
    own = got.where("_own").collect()
    assert sorted(r.id for r in own) == sorted(r[0] for r in data)
    assert got.count() < 2 * len(data)
    assert got.groupBy("key", "_piece").count().agg(F.max("count")).first()[0] < 250


def test_retain_newest(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "id bigint, key string, us bigint, kind string")
    newest = sorted(((us, i) for i, _, us, _ in data), reverse=True)
    df = df.unionByName(spark.createDataFrame([(9999, "k", None, "x")], df.schema))
    for n in (0, 1, 99, 499, 500, 900):
        for radix, ranked in ((1024, 100_000), (4, 10), (2, 1)):
            kept = retain_newest(df, n, "us", ["id"], radix, ranked)
            assert {r.id for r in kept.collect()} == {i for _, i in newest[:n]}
    plan = retain_newest(df, 99, "us", ["id"], 4, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.replace("TakeOrderedAndProject", "")


def test_a_burst_is_cut_into_bounded_pieces(spark):
    """All rows of a key within one slot: no piece much above the limit, and windows stay exact."""
    df = spark.range(6000).selectExpr("0 as k", "id * 7000 as us", "id")
    cut = time_pieces(df, ["k"], "us", look_back=50, rows_per_piece=500)
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 500 + 50 + 1
    assert cut.where("_own").count() == 6000 and cut.where("_own").select("id").distinct().count() == 6000
    before = Window.partitionBy("k", "_piece").orderBy("us", "id")
    back = cut.withColumn("b", F.lag("id", 50).over(before)).where("_own and id >= 50")
    assert back.where("b = id - 50").count() == 5950
