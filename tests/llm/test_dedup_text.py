"""Repeated passages of lines and repeated runs of sentences."""

import random
from collections import defaultdict

import pytest
from compare import check, duck

from vigilog.llm import queries
from vigilog.llm.lines import chunks, dedup_lines, passages
from vigilog.llm.spans import dedup_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_line_chunks", "op10_sentence_spans"])
def test_queries_equal_sql(spark, name):
    assert check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)[0] is None


def test_chunks_do_not_shift():
    rng = random.Random(1)
    passage = [f"line {rng.random()}" for _ in range(60)]
    inner = {"\n".join(passage[a:b]) for a, b in chunks(passage)}
    for before in range(1, 9):
        lines = [f"own {rng.random()}" for _ in range(before)] + passage + ["end"]
        assert inner <= {"\n".join(lines[a:b]) for a, b in chunks(lines)}


def test_nearly_every_run_of_two_lines_is_a_chunk():
    rng = random.Random(2)
    pairs = [[f"a {rng.random()}", f"b {rng.random()}"] for _ in range(3000)]
    assert sum((0, 2) in chunks(p) for p in pairs) / len(pairs) > 0.975
    assert all(b - a > 1 for a, b in chunks([str(i) for i in range(500)]))
    assert chunks(["x"]) == [] == chunks(["", "", ""]) and all(a == 1 and b == 5 for a, b in chunks(["", "p q", "", "", "r"]))


def texts():
    rng = random.Random(4)
    shared = [[f"shared {k} {i} words of a line that stands in many texts" for i in range(9)] for k in range(3)]
    rows = []
    for d in range(40):
        lines = [f"own {d} {i} {rng.random()} more words here to fill." for i in range(rng.randint(0, 6))]
        if d % 2:
            lines[rng.randint(0, len(lines)):0] = rng.choice(shared)
        rows.append((d, "\n".join(lines), "x"))
    return rows + [(50, None, "x"), (51, "", "x"), (52, "\n\n\n", "x"), (53, "\n\n\n", "x"), (7, rows[7][1], "x"),
                   (None, rows[7][1], "x"), (54, "a b.\n" * 3000, "x"), (55, "\n".join(shared[0] * 300), "x")]


def kept_lines(rows):
    """(id, text, lines, removed) when every chunk goes but at its first place."""
    first, want = {}, []
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for a, _, body in passages(text or ""):
            first.setdefault(body, (d, a))
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = {i for a, b, body in passages(text or "") if d is not None and first[body] != (d, a) for i in range(a, b)}
        want.append((str(d), "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return want


def test_lines_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Removed string")
    want = kept_lines(rows)
    got = [(str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in want)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_spans_against_brute_force(spark):
    import re

    from vigilog.llm.spans import LEAST_WORDS, RUN, SENTENCE

    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ID string")
    first, split = {}, defaultdict(list)
    for d, text, _ in rows:
        split[d] = re.findall(SENTENCE, text or "")
    keys = lambda s: [(i, tuple(x.strip(" \t\n") for x in s[i:i + RUN])) for i in range(len(s) - RUN + 1)]
    counts = lambda k: sum(len(x.split()) for x in k) >= LEAST_WORDS
    for d in sorted(k for k in split if k is not None):
        for i, k in keys(split[d]):
            if counts(k):
                first.setdefault(k, (d, i))
    want = []
    for d, _, _ in rows:
        s = split[d]
        gone = {j for i, k in keys(s) if d is not None and counts(k) and first[k] != (d, i) for j in range(i, i + RUN)}
        want.append((str(d), "".join(x for i, x in enumerate(s) if i not in gone), len(s), len(gone)))
    got = [(str(r.doc_id), r.text, r.n_sentences, r.n_removed) for r in dedup_spans(docs).collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in want)
    assert dedup_spans(docs.limit(0)).count() == 0
