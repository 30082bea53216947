"""Only texts that may be wanted are shuffled when sets are fetched."""

from pyspark.sql import functions as F

from vigilog.llm import neardup


def test_every_wanted_text_and_few_others(spark, monkeypatch):
    docs = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    docs = docs.unionByName(docs.where("doc_id % 1000 = 0")).unionByName(spark.createDataFrame([(None, "b")], "doc_id long, text string"))
    ids = docs.where("doc_id % 100 = 0").select("doc_id").distinct()
    got = neardup.marked_texts(docs, ids)
    assert got.columns == docs.columns
    assert got.where("doc_id % 100 = 0").count() == 400 + 40
    assert got.count() < 440 + 40  # of 39,600 others one in 20,000 shares a mark
    monkeypatch.setattr(neardup, "MARKS", 128)  # marks are full: nothing is lost
    assert neardup.marked_texts(docs, ids).where("doc_id % 100 = 0").count() == 440
    assert neardup.marked_texts(docs, ids.limit(0)).count() == 0
