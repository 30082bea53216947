"""Repeated stretches of short sentences."""

import random

from compare import check, duck

from vigilog.llm import queries
from vigilog.llm.spans import LEAST_WORDS, dedup_spans

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    name = "op10_lengthened_spans"
    assert check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)[0] is None


def test_stretches_of_short_sentences_go_whole(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    sentence = lambda n: " ".join(word() for _ in range(n)) + ". "
    sizes = [[1] * 60, [2, 1, 3] * 9, [20, 1, 1], [1, 1, 20], [5, 1, 5], [4, 1, 1, 1, 4], [9, 9, 1], [12, 3], [1] * LEAST_WORDS]
    rows, want = [], {}
    for k, ns in enumerate(sizes):
        stretch = "".join(sentence(n) for n in ns)
        head, tail = sentence(3), sentence(4)
        first = sentence(2) + stretch + sentence(5)
        rows += [(k, first), (100 + k, head + stretch + tail)]
        want |= {k: first, 100 + k: head + tail}
    short = "".join(sentence(1) for _ in range(LEAST_WORDS - 1))  # too few words: stays
    rows += [(50, sentence(3) + short), (51, short + sentence(3))]
    want |= dict(rows[-2:])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_spans(docs, lengthen=True).collect()} == want
