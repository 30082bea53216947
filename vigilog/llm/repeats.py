"""Which keyed places of documents repeat an earlier one, without gathering a key's places anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import checkpointed


def repeated(places: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """(doc_id, places) for documents that hold a key met more than once.

    ``places`` is an array of structs (place, *also, in_first): ``in_first`` marks places in the
    document of smallest id that holds the key; the caller keeps the first of them there. Keys are
    counted before they are shuffled. The counts are a written table, so both sides of the join are
    shuffled for it alone and Spark splits the places of a hot key over tasks. Rows that repeat an id and a place count as one place.
    """
    seen = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    return (places.join(checkpointed(seen.where("_n > 1")), keys)
            .groupBy("doc_id").agg(F.collect_set(F.struct(
                "place", *also, (F.col("doc_id") == F.col("_first")).alias("in_first"))).alias("places")))


def later(places: list[dict], key: str) -> list[dict]:
    """Of a document's repeated places, those that are not the first of their key."""
    out, met = [], set()
    for p in sorted(places or (), key=lambda p: p["place"]):
        if p["in_first"] and p[key] not in met:
            met.add(p[key])
        else:
            out.append(p)
    return out
