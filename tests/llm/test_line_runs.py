"""Repeated passages inside documents that are otherwise different."""

import random

from compare import check, duck
from test_dedup_text import texts

from vigilog.llm import queries
from vigilog.llm.lines import dedup_runs

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    name = "op3_line_runs"
    assert check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)[0] is None


def test_passages_inside_other_documents_go(spark):
    rng = random.Random(5)
    passages = [[f"passage {k} line {i}" for i in range(n)] for k, n in enumerate([2, 2, 2, 3, 3, 4, 6] * 6)]
    passages = [p[:1] + [""] + p[1:] if k % 5 == 0 else p for k, p in enumerate(passages)]
    own = lambda d: [f"own {d} {i} {rng.random()}" for i in range(rng.randint(1, 4))]
    first = {k: "\n".join(own(k) + p + own(k)) for k, p in enumerate(passages)}
    rows, want = list(first.items()), dict(first)
    for k, p in enumerate(passages):
        head, tail = own(100 + k), own(100 + k)
        rows.append((100 + k, "\n".join(head + p + tail)))
        want[100 + k] = "\n".join(head + tail)
    got = dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_runs_against_brute_force(spark):
    rows = texts()
    met, gone = set(), {}
    for d, text in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x]
        for a, b in zip(filled, filled[1:]):
            body = tuple(lines[a:b + 1])
            if body in met:
                gone.setdefault(d, set()).update(range(a, b + 1))
            met.add(body)
    want = []
    for d, text, _ in rows:
        lines, own = (text or "").split("\n"), gone.get(d, set())
        want.append((str(d), "\n".join(x for i, x in enumerate(lines) if i not in own), len(lines), len(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Removed string")
    got = [(str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in dedup_runs(docs).collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in want)
    lines_of = lambda texts: {x for t in texts for x in (t or "").split("\n")}
    assert lines_of(r[1] for r in got) >= lines_of(r[1] for r in rows) - {""}
    assert dedup_runs(docs.limit(0)).count() == 0
