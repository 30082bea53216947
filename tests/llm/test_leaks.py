"""Benchmark items in documents."""

import random

from vigilog.llm import leaks
from vigilog.llm.leaks import Hashes, decontaminate, tiles, with_leaks, words_of

SF = "/root/testdata/sf0.01"


def plain_tiles(item, doc, shortest):
    """By the definition: again and again mark the longest common run of unmarked words."""
    item_free, doc_free, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and item_free[i + n] and doc_free[d + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < shortest:
            return out
        n, i, d = best
        item_free[i:i + n] = [False] * n
        doc_free[d:d + n] = [False] * n
        out.append((i, d, n))


def test_tiles_equal_the_definition():
    rng = random.Random(7)
    for _ in range(300):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
        doc = [rng.choice("abcde") for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.7 and len(item) > 6:  # pieces of the item in another order
            cut = rng.randint(2, len(item) - 2)
            at = rng.randint(0, len(doc))
            doc[at:at] = item[cut:] + ["x"] + item[:cut]
        got, want = tiles(item, doc, Hashes(), 3), plain_tiles(item, doc, 3)
        # which of equally long tiles is taken first may change what is left for short ones
        assert sorted(t[2] for t in got)[-1:] == sorted(t[2] for t in want)[-1:]
        assert all(item[i:i + n] == doc[d:d + n] and n >= 3 for i, d, n in got)
        for side in (0, 1):
            places = [p for t in got for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))


def test_reordered_passage(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    words = item.split()
    rows = [(1, "Start. " + " ".join(words[6:]) + " and then " + " ".join(words[:6]).upper() + " end", 0),
            (2, " ".join(words[:6]) + " nothing else", 0), (3, None, 0), (4, "", 0), (None, item, 0),
            (5, "filler " * 30_000 + item, 0), (5, "filler " * 30_000 + item, 0), (6, " ".join(reversed(words)), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LEAKS int")
    items = spark.createDataFrame([(9, item, 1), (9, item, 1), (8, "short item", 1), (7, None, 1), (None, item, 1)],
                                  "item_id long, text string, doc_id long")
    got = with_leaks(docs, items).collect()
    found = sorted((str(r.doc_id), [x.item_id for x in r.leaks]) for r in got)
    assert found == [("1", [9]), ("2", []), ("3", []), ("4", []), ("5", [9]), ("5", [9]), ("6", []), ("None", [9])]
    one = next(r for r in got if r.doc_id == 1).leaks[0]
    assert one.coverage == 1.0 and [(t.item_word, t.words) for t in one.tiles] == [(0, 6), (6, 6)]
    text = words_of(rows[0][1])
    assert all(text[t.doc_word:t.doc_word + t.words] == words[t.item_word:t.item_word + t.words] for t in one.tiles)
    assert decontaminate(docs, items).count() == 4
    assert decontaminate(docs, items.limit(0)).count() == 8 and with_leaks(docs.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in df.collect())
    whole = key(with_leaks(docs, items))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 600)
    assert key(with_leaks(docs, items)) == whole and any(k for _, k in whole)


def test_query_against_shared_words(spark):
    """An item that stands whole in a document is found, and what is found shares its words."""
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in leaks.op9_benchmark_tiling(spark, SF).collect()}
    for d, words in docs.items():
        runs = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        joined = " " + " ".join(words) + " "
        for i, item in items.items():
            seeds = [tuple(item[k:k + 5]) in runs for k in range(len(item) - 4)]
            covered = {p for k, hit in enumerate(seeds) if hit for p in range(k, k + 5)}
            if " " + " ".join(item) + " " in joined:
                assert i in got[d]
            if len(covered) < leaks.COVERAGE * len(item):
                assert i not in got[d]


def test_query_equals_plain_tiling(spark):
    """Every document against every item by the definition of the tiling, wherever they share a run of words."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: words_of(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for d, words in docs.items():
        runs = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        for i, item in items.items():
            if any(tuple(item[k:k + 5]) in runs for k in range(len(item) - 4)):
                share = sum(n for _, _, n in plain_tiles(item, words, 5)) / len(item)
                if share >= leaks.COVERAGE:
                    want[d, i] = share
    got = leaks.op9_benchmark_tiling(spark, sf).collect()
    assert {(r.doc_id, i) for r in got for i in r.item_ids} == set(want) and len(want) >= 3
    for r in got:
        best = max((share for (d, _), share in want.items() if d == r.doc_id), default=0.0)
        assert abs(r.coverage - best) < 1e-12 and r.contaminated == (best > 0)
