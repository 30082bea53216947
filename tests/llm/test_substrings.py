"""Removal of repeated strings against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from vigilog.llm import substrings
from vigilog.llm.common import table
from vigilog.llm.substrings import op4_suffix_arrays, remove_repeats, repeated_windows, suffix_ranks

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    met = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            met[t[i:i + length]] = met.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if met[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_ranks_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(20):
        bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))) for _ in range(6)]
        text = b"".join(bodies)
        ranks = suffix_ranks(np.frombuffer(text, np.uint8))
        assert np.argsort(ranks).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        starts, windows, mask, distinct = repeated_windows(bodies, 12)
        met = [b[i:i + 12] for b in bodies for i in range(len(b) - 11)]
        at = [int(s) + i for s, n in zip(starts, windows) for i in range(n)]
        assert [bool(mask[p]) for p in at] == [met.count(w) > 1 for w in met]
        assert len(distinct) == len(set(met))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text.encode()) for r in table(spark, SF, "documents").collect()]
    want = {d: w for (d, _), w in zip(rows, brute([t for _, t in rows], 200))}
    got = {r.doc_id: tuple(r)[1:] for r in op4_suffix_arrays(spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("rows_in_shard,piece", [(10_000, 1 << 20), (3, 64)])
def test_odd_rows_and_split_anchors(spark, monkeypatch, rows_in_shard, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    shared = " ".join(word() for _ in range(14))
    texts = [" ".join(word() for _ in range(8)) + shared[rng.randint(0, 20):rng.randint(40, 99)] + " ".join(
        word() for _ in range(8)) for _ in range(60)]
    texts += [None, "", "short", texts[0], texts[0], "a" * 3000, "xy" * 700, shared]
    rows = [(i % 50, t, 1) for i, t in enumerate(texts)] + [(None, texts[1], 1), (None, texts[2], 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Spans int")
    got = remove_repeats(docs, length=30, gram=12, shard_bytes=2000, shard_rows=rows_in_shard).collect()
    want = brute([(t or "").encode() for _, t, _ in rows], 30)
    key = lambda d, t, x: (str(d), t or "", *x)
    assert sorted(key(r.doc_id, r.text, (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()))
                  for r in got) == sorted(key(d, t, w) for (d, t, _), w in zip(rows, want))
    assert remove_repeats(docs.limit(0)).count() == 0


def test_texts_with_equal_checksums_and_no_id(spark):
    rng = random.Random(9)
    tail = bytes(rng.choice(b"abcdefgh ") for _ in range(600))
    met = {}
    while True:
        head = bytes(rng.choice(b"abcdefghijkl") for _ in range(12))
        other = met.setdefault(zlib.crc32(head + tail), head)
        if other != head:
            break
    texts = [(head + tail).decode(), (other + tail).decode()]
    rows = [(None, t) for t in texts] + [(7, texts[0][:300]), (7, texts[1][:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == sorted((t, w[1]) for (_, t), w in zip(rows, brute([t.encode() for _, t in rows], 200)))


def test_repeated_rows_hand_on_their_bytes_once(spark):
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = spark.createDataFrame([(1, text)] * 40 + [(None, text)] * 40 + [(2, text[:250])], "doc_id long, text string").repartition(5)
    got = remove_repeats(docs).collect()
    assert len(got) == 81 and all(r.n_removed == r.n_bytes for r in got)
