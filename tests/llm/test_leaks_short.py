"""Benchmark items of few words, and items without an id."""

from vigilog.llm.leaks import decontaminate, with_leaks


def test_short_items_and_null_ids(spark):
    items = spark.createDataFrame(
        [(1, "Quagga"), (2, "the blue whale"), (3, "東京都は日本の首都である"), (4, "..."),
         (None, "seven words of an item without id")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "It was a quagga, they said."), (2, "We saw the blue, no whale"), (3, "We saw The Blue Whale."),
         (4, "x\n東京都は日本の首都である。y"), (5, "here: seven words of an item without id, as given"), (6, "..."), (7, None)],
        "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in with_leaks(docs, items).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [3], 5: [None], 6: [], 7: []}
    assert {r.doc_id for r in decontaminate(docs, items).collect()} == {2, 6, 7}
