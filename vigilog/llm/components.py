"""Connected components of links, as joins and aggregates over written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(v, label) for the ends of ``links`` (a, b): the smallest vertex that can be reached.

    Labels spread over links and then jump to the label of their label, so the rounds grow with
    the logarithm of a component's width.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("v")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "v").select("v", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        after = checkpointed(spread.join(far, "label").select(
            "v", "before", F.least("label", "far").alias("label")))
        labels = after.select("v", "label")
        if after.where("label < before").isEmpty():
            return labels
