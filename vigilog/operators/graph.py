"""The entity graph of alerts: nodes, edges and walks over them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.net import is_ip
from vigilog.functions.text import strip
from vigilog.session import checkpointed

MAX_DEPTH = 3


def tactic_names(tactic) -> "F.Column":
    """A compound tactic to its parts."""
    return F.filter(F.transform(F.split(tactic, "→"), strip), lambda t: t != "")


def build_graph(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an alert table.

    nodes: id, type, label, severity, alert_type, us, hit_count (alerts), alert_count (sources).
    The label of the earliest alert that names a node stands.
    """
    a = alerts.where(F.coalesce("alert_id", F.lit("")) != "").select(
        F.concat(F.lit("alert:"), "alert_id").alias("alert"), "title", "severity", "alert_type",
        "us", "hit_count", "chain_id", "mitre_techniques",
        F.when(F.col("source_key") != "", F.concat(
            F.when(is_ip(F.col("source_key")), "ip:").otherwise("host:"), "source_key"))
        .alias("source"),
        F.col("source_key"), tactic_names(F.col("mitre_tactic")).alias("tactics"))
    empty = {
        "severity": "string", "alert_type": "string", "alert_us": "bigint", "hits": "bigint"}
    blanks = [F.lit(None).cast(t).alias(n) for n, t in empty.items()]
    linked = lambda column, kind, label: a.where(F.col(column) != "").select(
        F.concat(F.lit(kind + ":"), column).alias("id"), F.lit(kind).alias("type"),
        F.col(label).alias("label"), "us", *blanks, F.lit(0).cast("bigint").alias("fired"))

    def listed(column, kind):
        return a.select("us", F.explode(column).alias("x")).select(
            F.concat(F.lit(kind + ":"), "x").alias("id"), F.lit(kind).alias("type"),
            F.col("x").alias("label"), "us", *blanks, F.lit(0).cast("bigint").alias("fired"))

    rows = a.select(
        F.col("alert").alias("id"), F.lit("alert").alias("type"), F.col("title").alias("label"),
        "us", "severity", "alert_type", F.col("us").alias("alert_us"),
        F.col("hit_count").cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("fired"),
    ).unionByName(a.where("source is not null").select(
        F.col("source").alias("id"),
        F.when(F.startswith("source", F.lit("ip:")), "source_ip").otherwise("host").alias("type"),
        F.col("source_key").alias("label"), "us", *blanks,
        F.lit(1).cast("bigint").alias("fired"))
    ).unionByName(listed("tactics", "tactic")).unionByName(
        listed("mitre_techniques", "technique")).unionByName(linked("chain_id", "chain", "title"))
    nodes = rows.groupBy("id").agg(
        F.first("type").alias("type"), F.min_by("label", F.struct("us", "label")).alias("label"),
        F.max("severity").alias("severity"), F.max("alert_type").alias("alert_type"),
        F.max("alert_us").alias("us"), F.max("hits").alias("hit_count"),
        F.sum("fired").alias("alert_count"))

    edge = lambda rows, s, t, r: rows.select(
        s.alias("source"), t.alias("target"), F.lit(r).alias("relation"))
    c = F.col
    by_tactic = a.select("alert", "mitre_techniques", F.explode("tactics").alias("t"))
    tactic = F.concat(F.lit("tactic:"), "t")
    technique = F.concat(F.lit("technique:"), "x")
    edges = (
        edge(a.where("source is not null"), c("source"), c("alert"), "fired")
        .unionByName(edge(by_tactic, c("alert"), tactic, "belongs_to"))
        .unionByName(edge(a.select("alert", F.explode("mitre_techniques").alias("x")),
                          c("alert"), technique, "maps_to"))
        .unionByName(edge(by_tactic.select("t", F.explode("mitre_techniques").alias("x")),
                          technique, tactic, "belongs_to"))
        .unionByName(edge(a.where("chain_id <> ''"), c("alert"),
                          F.concat(F.lit("chain:"), "chain_id"), "part_of"))
        .dropDuplicates(["source", "target", "relation"])
    )
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(here, there) in both directions, each pair once."""
    there = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return there.unionByName(back).distinct()


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    near = both_ways(edges).where(F.col("here") == node_id).select(F.col("there").alias("id"))
    return nodes.join(near, "id", "left_semi")


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``ids(id)`` and the edges between them."""
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside.select("source", "target", "relation")


def subgraph(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1
             ) -> tuple[DataFrame, DataFrame]:
    """Everything within ``depth`` (1 to 3) hops of a node, and the edges between."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    links = both_ways(edges)
    reached = nodes.where(F.col("id") == node_id).select("id")
    for _ in range(depth):
        step = links.join(reached.withColumnRenamed("id", "here"), "here").select(
            F.col("there").alias("id"))
        reached = reached.unionByName(step).distinct()
    return induced(nodes, edges, reached)


def component_of(nodes: DataFrame, edges: DataFrame, node_id: str
                 ) -> tuple[DataFrame, DataFrame]:
    """What a source reaches without passing through another source address.

    Each round joins only the newly reached nodes; it ends when a round finds none.
    """
    passable = nodes.where((F.col("type") != "source_ip") | (F.col("id") == node_id)).select("id")
    links = checkpointed(both_ways(edges).join(
        passable.withColumnRenamed("id", "there"), "there", "left_semi"))
    reached = checkpointed(nodes.where(F.col("id") == node_id).select("id"))
    newest = reached
    while True:
        step = links.join(newest.withColumnRenamed("id", "here"), "here").select(
            F.col("there").alias("id")).distinct()
        newest = checkpointed(step.join(reached, "id", "left_anti"))
        if newest.isEmpty():
            return induced(nodes, edges, reached)
        reached = checkpointed(reached.unionByName(newest))


def describe(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row about an entity: its alerts (first ten), techniques, tactics and chains.

    Where the entity itself has no technique or no tactic, those of its alerts are taken.
    """
    links = both_ways(edges)
    near = nodes.join(links.where(F.col("here") == node_id).select(F.col("there").alias("id")),
                      "id", "left_semi").select("id", "type", "label", "severity")
    alerts_near = near.where("type = 'alert'")
    beyond = links.join(alerts_near.select(F.col("id").alias("here")), "here").select(
        F.col("there").alias("id")).distinct()
    far = nodes.join(beyond, "id", "left_semi").where("type in ('technique', 'tactic')").select(
        "id", "type", "label", "severity")
    kinds = near.groupBy().agg(
        F.count_if(F.col("type") == "alert").alias("alerts"),
        (F.count_if(F.col("type") == "technique") == 0).alias("no_technique"),
        (F.count_if(F.col("type") == "tactic") == 0).alias("no_tactic"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "technique", F.col("label"))))
        .alias("near_techniques"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "tactic", F.col("label"))))
        .alias("near_tactics"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "chain", F.col("label"))))
        .alias("chains"))
    further = far.groupBy().agg(
        F.collect_set(F.when(F.col("type") == "technique", F.col("label"))).alias("far_techniques"),
        F.collect_set(F.when(F.col("type") == "tactic", F.col("label"))).alias("far_tactics"))
    first_ten = alerts_near.orderBy("id").limit(10).groupBy().agg(F.array_sort(F.collect_list(
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "label"))).alias("first_alerts"))
    me = nodes.where(F.col("id") == node_id).select("id", "type", "label", "alert_count")
    one = F.lit(1).alias("_one")
    rows = me.select("*", one)
    for part in (kinds, further, first_ten):  # one row each
        rows = rows.join(part.select("*", one), "_one")
    extra = F.col("no_technique") | F.col("no_tactic")
    merged = lambda a, b: F.array_sort(F.when(
        extra, F.array_union(a, b)).otherwise(F.col(a)))
    return rows.select(
        "id", "type", "label", "alert_count", "alerts", "first_alerts",
        merged("near_techniques", "far_techniques").alias("techniques"),
        merged("near_tactics", "far_tactics").alias("tactics"), "chains")
