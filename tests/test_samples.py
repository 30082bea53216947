"""The rows drawn for each tree."""

from pyspark.sql import functions as F

from vigilog.operators.forest import tree_samples


def test_smallest_hashes_are_drawn_without_lambdas(spark):
    keys = spark.range(400).select(F.concat(F.lit("e"), "id").alias("event_id"))
    drawn = tree_samples(keys, "event_id", 400, 6, 42, sample=20)
    want = []
    for tree in range(6):
        hashed = keys.select("event_id", F.xxhash64("event_id", F.lit(tree), F.lit(42)).alias("h")).collect()
        best = sorted((r.h, r.event_id) for r in hashed)[:20]
        want += [(tree, n + 1, event_id) for n, (_, event_id) in enumerate(best)]
    assert sorted((r._tree, r._rank, r.event_id) for r in drawn.collect()) == want
    # a lambda is interpreted for each event and tree
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
