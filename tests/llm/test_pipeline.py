"""The pipeline, stage by stage, against plain versions of its decisions."""

import corpus_pipeline as pipeline
from test_dedup_text import kept_lines
from test_neardup import brute

from vigilog.llm.common import table
from vigilog.llm.leaks import words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, stages = table(spark, SF, "documents"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        stages.append((docs.columns, {r.doc_id: r.text for r in docs.collect()}))
    assert all(c == columns for c, _ in stages[:-1])
    start = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    polite, cut, unique, clean, final = (s for _, s in stages)
    assert sum((d not in polite) != bool(t) for d, t in toxic.items()) <= 0.1 * len(toxic)
    assert all(polite[d] == start[d] for d in polite)

    want = {int(d): text for d, text, _, removed in kept_lines(list(polite.items())) if not removed or text.strip(" ")}
    assert cut == want

    component = brute(list(cut.items()), 5, 80)
    assert unique == {d: t for d, t in cut.items() if component[d] == d}
    items = [words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    for d, text in unique.items():
        joined = f" {' '.join(words_of(text))} "
        if any(f" {' '.join(item)} " in joined for item in items):
            assert d not in clean
    assert set(clean) <= set(unique) and final == clean


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None, 1), (2, "", "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (None, "some text", None, None, 9, 1),
         (3, "x " * 50_000, "en", "s", 100_000, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, LEAKS int")
    for _, stage in pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 5 and (stage is pipeline.tokens or got.columns == docs.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert entry.queries()["pipeline"](spark, SF).count() > 0
