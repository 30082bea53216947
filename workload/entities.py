"""Addresses, the entity graph, incidents."""

from pyspark.sql import functions as F

from vigilog.functions.net import is_ip, is_private, is_rfc1918
from vigilog.functions.severity import abuse_labels, risk_level
from vigilog.operators import graph as G
from vigilog.operators import incidents as I
from vigilog.operators.enrich import enrich_as_of, enrich_by_network, enrich_ips
from vigilog.operators.reports import source_map
from vigilog.values import ABUSE_CATEGORIES
from workload.base import SOURCE_IP, VALID_SQL, alerted, alerts, ev, events, query, stage, table, wide

PLACE_SQL = """places AS (SELECT (CASE WHEN c_custkey % 3 = 0 THEN '203.' ELSE '10.' END) || (c_custkey // 250)
  || (CASE WHEN c_custkey % 3 = 0 THEN '.113.' ELSE '.0.' END) || (c_custkey % 250) AS ip,
  c_nationkey AS latitude, c_custkey % 90 + 1 AS longitude, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_acctbal AS INT) % 100 END
  AS abuse_score FROM customer WHERE c_custkey % 7 <> 0)"""


def places(spark, sf):
    """One row per source address with place and reputation."""
    return table(spark, sf, "customer").where("c_custkey % 7 <> 0").selectExpr(
        SOURCE_IP.replace("user_id", "c_custkey") + " as ip",
        "cast(c_nationkey as double) as latitude", "cast(c_custkey % 90 + 1 as double) as longitude",
        "case when c_custkey % 4 > 0 then cast(round(c_acctbal) as int) % 100 end as abuse_score",
        "array(array(cast(c_custkey % 30 as int), 18), array(22)) as abuse_category_ids")


def with_places(sql: str) -> str:
    return sql.replace("WITH RECURSIVE ", "WITH RECURSIVE " + PLACE_SQL + ",\n", 1)


PRIVATE_SQL = "starts_with(ip, '10.')"
RISK_SQL = f"""CASE WHEN {PRIVATE_SQL} THEN 'internal' WHEN abuse_score IS NULL THEN 'unknown'
  WHEN abuse_score >= 75 THEN 'high' WHEN abuse_score >= 25 THEN 'medium' ELSE 'low' END"""


@query("j4_ip_enrichment", wide(with_places(ev(f"""SELECT a.ip, private AS is_private,
  {RISK_SQL.replace(PRIVATE_SQL, 'private')} AS risk_level, CASE WHEN NOT private THEN latitude END AS latitude,
  CASE WHEN NOT valid THEN 'Invalid IP address' WHEN NOT private AND longitude IS NULL THEN 'No enrichment data' END AS error
  FROM (SELECT ip, valid, valid AND {PRIVATE_SQL} AS private FROM (SELECT DISTINCT source_ip AS ip,
    {VALID_SQL.format(ip='source_ip')} AS valid FROM ev WHERE source_ip IS NOT NULL)) a LEFT JOIN places p ON valid AND p.ip = a.ip"""))))
def enriched(spark, sf):
    return enrich_ips(events(spark, sf), places(spark, sf), "source_ip").select(
        "ip", "is_private", "risk_level", F.col("latitude").cast("int").alias("latitude"), "error")


@query("j4_network_enrichment", """WITH nets AS (SELECT DISTINCT 167772160 + (s_suppkey // 50 % 6) * 65536 + (s_suppkey % 50) * 5 AS lo,
    CASE WHEN s_suppkey % 10 = 0 THEN 65535 ELSE 4 END AS width FROM supplier),
  ips AS (SELECT DISTINCT (CASE WHEN user_id % 3 = 0 THEN '203.' ELSE '10.' END) || (user_id // 250) || (CASE WHEN user_id % 3 = 0
    THEN '.113.' ELSE '.0.' END) || (user_id % 250) AS ip, CASE WHEN user_id % 3 = 0 THEN 3405774848 + (user_id // 250) * 65536
    + 113 * 256 + user_id % 250 ELSE 167772160 + (user_id // 250) * 65536 + user_id % 250 END AS n FROM events WHERE user_id < 64000
    UNION SELECT DISTINCT (CASE WHEN user_id % 3 = 0 THEN '203.' ELSE '10.' END) || (user_id // 250) || (CASE WHEN user_id % 3 = 0
    THEN '.113.' ELSE '.0.' END) || (user_id % 250), NULL FROM events WHERE user_id >= 64000 AND event_id % 5 = 2)
  SELECT ip, arg_min(lo, width * 10000000000 + lo) AS ip_lo, arg_min(lo + width, width * 10000000000 + lo) AS ip_hi
  FROM ips LEFT JOIN nets ON n BETWEEN lo AND lo + width GROUP BY ip""")
def networks(spark, sf):
    nets = table(spark, sf, "supplier").selectExpr(
        "167772160L + (s_suppkey div 50 % 6) * 65536 + (s_suppkey % 50) * 5 as ip_lo",
        "case when s_suppkey % 10 = 0 then 65535L else 4L end as width").distinct().selectExpr(
        "ip_lo", "ip_lo + width as ip_hi")
    return enrich_by_network(events(spark, sf), nets, "source_ip").select("ip", "ip_lo", "ip_hi")


@query("j5_private_range", """SELECT ip, starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '127.')
  OR starts_with(ip, '169.254.') OR (starts_with(ip, '172.') AND CAST(string_split(ip, '.')[2] AS INT) BETWEEN 16 AND 31)
  AS is_private FROM (SELECT (['10', '172', '192', '127', '169', '8', '203'])[l_orderkey % 7 + 1] || '.' ||
  (CASE l_orderkey % 7 WHEN 2 THEN 168 - l_linenumber % 2 WHEN 4 THEN 254 - l_linenumber % 2 ELSE l_partkey % 40 END) || '.'
  || l_suppkey % 256 || '.' || l_linenumber AS ip FROM lineitem)""")
def private(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat(element_at(array('10','172','192','127','169','8','203'), cast(l_orderkey % 7 + 1 as int)), '.', "
        "case l_orderkey % 7 when 2 then 168 - l_linenumber % 2 when 4 then 254 - l_linenumber % 2 "
        "else l_partkey % 40 end, '.', l_suppkey % 256, '.', l_linenumber) as ip")
    return rows.select("ip", is_private(F.col("ip")).alias("is_private"))


def lookups(spark, sf):
    return events(spark, sf).where("message like '%GET /admin%'").select(
        F.col("source_ip").alias("ip"), F.col("us").alias("enriched_us"),
        F.col("event_id").alias("lookup_id"))


@query("j6_fresh_enrichment", wide(ev("""SELECT e.event_id, arg_max(v.event_id, v.us) AS lookup_id FROM ev e LEFT JOIN ev v
  ON v.ty = 'view' AND v.source_ip = e.source_ip AND v.us <= e.us AND e.us - v.us < 36000000000
  WHERE e.ty = 'error' GROUP BY e.event_id""")))
def fresh(spark, sf):
    asked = events(spark, sf).where("message like 'Failed%'").select("event_id", "source_ip", "us")
    return enrich_as_of(asked, lookups(spark, sf), "source_ip", "us", 36000).select(
        "event_id", "lookup_id")


@query("j7_distinct_ips", wide(ev(f"""SELECT count(DISTINCT source_ip) AS ips, CAST(count(DISTINCT CASE WHEN starts_with(source_ip, '10.')
  AND {VALID_SQL.format(ip='source_ip')} THEN source_ip END) AS BIGINT) AS private_ips FROM ev""")))
def distinct_ips(spark, sf):
    return enrich_ips(events(spark, sf), places(spark, sf), "source_ip").agg(
        F.count(F.lit(1)).alias("ips"), F.count_if("is_private").alias("private_ips"))


@query("a18_source_map", with_places(alerted(f"""SELECT ip, count(*) AS alerts, CASE max(CASE severity WHEN 'critical' THEN 4
  WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium'
  ELSE 'low' END AS top_severity, any_value(latitude) AS latitude FROM alerts JOIN places ON ip = source_key
  WHERE NOT {PRIVATE_SQL} AND latitude <> 0 GROUP BY ip""")))
def mapped(spark, sf):
    located = enrich_ips(alerts(spark, sf), places(spark, sf), "source_key")
    return source_map(alerts(spark, sf), located).select(
        "ip", "alerts", "top_severity", F.col("latitude").cast("int").alias("latitude"))


@query("x9_is_rfc1918", ev("SELECT source_ip, starts_with(source_ip, '10.') AS inside, count(*) AS n FROM ev GROUP BY ALL"))
def rfc1918(spark, sf):
    return events(spark, sf).groupBy("source_ip", is_rfc1918(F.col("source_ip")).alias("inside")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x15_risk_level", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'internal' WHEN p_partkey % 7 = 0 THEN 'unknown'
  WHEN p_size * 2 >= 75 THEN 'high' WHEN p_size * 2 >= 25 THEN 'medium' ELSE 'low' END AS risk FROM part""")
def risk(spark, sf):
    return table(spark, sf, "part").select("p_partkey", risk_level(
        F.col("p_partkey") % 5 == 0,
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 2)).alias("risk"))


_NAMED = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in ABUSE_CATEGORIES.items()) + "}"


@query("x16_abuse_labels", f"""SELECT c_custkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(
  [c_custkey % 30, 18, 22], lambda k: m[k]), lambda x: x IS NOT NULL))), ','), '') AS labels
  FROM customer, (SELECT {_NAMED} AS m)""")
def labels(spark, sf):
    reports = F.expr("array(array(cast(c_custkey % 30 as int), 18), array(22))")
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(abuse_labels(reports), ",").alias("labels"))


@query("x17_tactic_split", alerted("""SELECT trim(t) AS tactic, count(*) AS n FROM (SELECT unnest(string_split(mitre_tactic, '→'))
  AS t FROM alerts) WHERE trim(t) <> '' GROUP BY ALL"""))
def tactics(spark, sf):
    return alerts(spark, sf).select(F.explode(G.tactic_names(F.col("mitre_tactic"))).alias("tactic")
                                    ).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))


@query("x18_is_ip", ev("SELECT host, false AS host_is_ip, true AS source_is_ip, count(*) AS n FROM ev GROUP BY ALL"))
def addresses(spark, sf):
    return events(spark, sf).groupBy("host", is_ip(F.col("host")).alias("host_is_ip"),
                                     is_ip(F.col("source_ip")).alias("source_is_ip")).agg(
        F.count(F.lit(1)).alias("n"))


# -- graph -----------------------------------------------------------------------------------

GRAPH_SQL = """tacs AS (SELECT DISTINCT alert_id, trim(t) AS tactic FROM (SELECT alert_id, unnest(string_split(mitre_tactic, '→')) AS t
  FROM alerts) WHERE trim(t) <> ''),
techs AS (SELECT DISTINCT alert_id, t AS tech FROM (SELECT alert_id, unnest(string_split(techniques, ',')) AS t FROM alerts)
  WHERE t <> ''),
edges AS (SELECT 'ip:' || source_key AS source, 'alert:' || alert_id AS target, 'fired' AS relation FROM alerts
  UNION SELECT 'alert:' || alert_id, 'tactic:' || tactic, 'belongs_to' FROM tacs
  UNION SELECT 'alert:' || alert_id, 'technique:' || tech, 'maps_to' FROM techs
  UNION SELECT 'technique:' || tech, 'tactic:' || tactic, 'belongs_to' FROM tacs JOIN techs USING (alert_id)
  UNION SELECT 'alert:' || alert_id, 'chain:' || chain_id, 'part_of' FROM alerts WHERE chain_id <> ''),
links AS (SELECT source AS here, target AS there FROM edges UNION SELECT target, source FROM edges),
nodes AS (SELECT id, split_part(id, ':', 1) AS kind FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges))"""


def graphed(body: str) -> str:
    head = alerted("").rstrip()
    return head + ",\n" + GRAPH_SQL + "\n" + body


def nodes(spark, sf):
    return stage(spark, sf, "nodes", lambda: G.build_graph(alerts(spark, sf))[0])


def edges(spark, sf):
    return stage(spark, sf, "edges", lambda: G.build_graph(alerts(spark, sf))[1])


HOME = "ip:203.0.113.3"


@query("g1_nodes", wide(graphed("""SELECT n.id, CASE n.kind WHEN 'ip' THEN 'source_ip' ELSE n.kind END AS type,
  coalesce(c.n, 0) AS alert_count, a.severity FROM nodes n LEFT JOIN (SELECT 'ip:' || source_key AS id, count(*) AS n FROM alerts
  GROUP BY source_key) c USING (id) LEFT JOIN (SELECT 'alert:' || alert_id AS id, severity FROM alerts) a USING (id)""")))
def all_nodes(spark, sf):
    return nodes(spark, sf).select("id", "type", "alert_count", "severity")


@query("g2_edges", wide(graphed("SELECT source, target, relation FROM edges")))
def all_edges(spark, sf):
    return edges(spark, sf)


@query("u2_distinct_edges", graphed("SELECT relation, count(*) AS n FROM edges GROUP BY relation"))
def edge_counts(spark, sf):
    return edges(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("g3_neighbors", graphed(f"SELECT there AS id FROM links WHERE here = '{HOME}'"))
def near(spark, sf):
    return G.neighbors(nodes(spark, sf), edges(spark, sf), HOME).select("id")


@query("j9_neighbor_counts", graphed("SELECT here AS id, count(*) AS degree FROM links GROUP BY here"))
def degrees(spark, sf):
    return G.both_ways(edges(spark, sf)).groupBy(F.col("here").alias("id")).agg(
        F.count(F.lit(1)).alias("degree"))


@query("g4_subgraph", graphed(f"""SELECT source, target, relation FROM edges, (SELECT list(DISTINCT id) AS ids FROM (
  SELECT '{HOME}' AS id UNION SELECT there FROM links WHERE here = '{HOME}' UNION SELECT b.there FROM links a
  JOIN links b ON b.here = a.there WHERE a.here = '{HOME}')) WHERE list_contains(ids, source) AND list_contains(ids, target)"""))
def hops(spark, sf):
    return G.subgraph(nodes(spark, sf), edges(spark, sf), HOME, 2)[1]


@query("g5_component", wide(graphed(f""", walk_ AS (SELECT id FROM nodes WHERE id = '{HOME}' UNION SELECT there FROM walk_ JOIN links ON here = walk_.id
  WHERE there NOT LIKE 'ip:%') SELECT id FROM walk_""").replace("\n, walk_", ",\nwalk_")))
def component(spark, sf):
    return G.component_of(nodes(spark, sf), edges(spark, sf), HOME)[0].select("id")


@query("g6_describe", graphed(f"""SELECT '{HOME}' AS id, count(*) AS alerts, (SELECT string_agg(DISTINCT tech, ',' ORDER BY tech)
  FROM techs JOIN alerts USING (alert_id) WHERE 'ip:' || source_key = '{HOME}') AS techniques,
  (SELECT string_agg(DISTINCT tactic, ',' ORDER BY tactic) FROM tacs JOIN alerts USING (alert_id)
  WHERE 'ip:' || source_key = '{HOME}') AS tactics FROM alerts WHERE 'ip:' || source_key = '{HOME}'"""))
def described(spark, sf):
    return G.describe(nodes(spark, sf), edges(spark, sf), HOME).select(
        "id", "alerts", F.array_join("techniques", ",").alias("techniques"),
        F.array_join("tactics", ",").alias("tactics"))


# -- incidents -------------------------------------------------------------------------------

ACTIONS_SQL = """actions AS (SELECT o_custkey AS incident_id, epoch_us(o_orderdate) AS us, o_orderkey AS seq,
  CASE WHEN o_orderkey % 6 < 3 THEN 'state' WHEN o_orderkey % 6 = 3 THEN 'owner' WHEN o_orderkey % 6 = 4 THEN 'note'
    ELSE 'disposition' END AS action,
  CASE WHEN o_orderkey % 6 < 3 THEN (['triaging', 'contained', 'closed', 'dismissed', 'triaging'])[o_orderkey % 5 + 1]
    WHEN o_orderkey % 6 = 3 THEN 'analyst' || o_orderkey % 5 WHEN o_orderkey % 6 = 4 THEN o_orderpriority
    ELSE (['true_positive', 'false_positive', 'benign_true_positive', 'undetermined'])[o_orderkey % 4 + 1] END AS value,
  o_orderkey % 4 AS prints FROM orders),
moves AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY us, seq) AS i FROM actions WHERE action = 'state'),
fold AS (SELECT DISTINCT incident_id, 0::BIGINT AS i, 'new' AS state, NULL::BIGINT AS closed_us, 0::BIGINT AS refused FROM actions
  UNION ALL SELECT f.incident_id, m.i, CASE WHEN ok THEN value ELSE state END,
    CASE WHEN ok AND value IN ('closed', 'dismissed') THEN m.us ELSE f.closed_us END, f.refused + CASE WHEN ok THEN 0 ELSE 1 END
  FROM fold f JOIN moves m ON m.incident_id = f.incident_id AND m.i = f.i + 1, LATERAL (SELECT (f.state = 'new' AND m.value IN
    ('triaging', 'dismissed')) OR (f.state = 'triaging' AND m.value IN ('contained', 'dismissed')) OR (f.state = 'contained'
    AND m.value IN ('closed', 'triaging')) AS ok)),
states AS (SELECT incident_id, arg_max(state, i) AS state, arg_max(closed_us, i) AS closed_any, max(closed_us) AS closed_us,
  arg_max(refused, i) AS refused FROM fold GROUP BY incident_id),
incidents AS (SELECT incident_id, state, closed_us, refused, a.* EXCLUDE (incident_id) FROM states JOIN (SELECT incident_id,
  min(us) AS created_us, arg_max(value, us * 1000000 + seq) FILTER (WHERE action = 'owner') AS owner,
  arg_max(value, us * 1000000 + seq) FILTER (WHERE action = 'disposition') AS disposition,
  count(*) FILTER (WHERE action = 'note') AS notes FROM actions GROUP BY incident_id) a USING (incident_id))"""


def acted(body: str) -> str:
    return "WITH RECURSIVE " + ACTIONS_SQL.replace("arg_max(value, us * 1000000 + seq)", "arg_max(value, (us, seq))") + "\n" + body


def actions(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey as incident_id", "unix_micros(cast(o_orderdate as timestamp)) as us", "o_orderkey as seq",
        "case when o_orderkey % 6 < 3 then 'state' when o_orderkey % 6 = 3 then 'owner' "
        "when o_orderkey % 6 = 4 then 'note' else 'disposition' end as action",
        "case when o_orderkey % 6 < 3 then element_at(array('triaging','contained','closed','dismissed','triaging'), "
        "cast(o_orderkey % 5 + 1 as int)) when o_orderkey % 6 = 3 then concat('analyst', o_orderkey % 5) "
        "when o_orderkey % 6 = 4 then o_orderpriority else element_at(array('true_positive','false_positive',"
        "'benign_true_positive','undetermined'), cast(o_orderkey % 4 + 1 as int)) end as value",
        "'someone' as author",
        "transform(sequence(1, cast(o_orderkey % 4 as int)), x -> concat('f', o_orderkey, '-', x)) as fingerprints")


def incidents(spark, sf):
    return stage(spark, sf, "incidents", lambda: I.fold_incidents(actions(spark, sf)))


@query("w15_incident_states", acted("""SELECT incident_id, state, closed_us, refused, owner, disposition, notes, created_us
  FROM incidents"""))
def folded(spark, sf):
    return incidents(spark, sf).select(
        "incident_id", "state", "closed_us", "refused", "owner", "disposition", "notes", "created_us")


@query("a19_incidents_by_state", acted("SELECT state, count(*) AS incidents FROM incidents GROUP BY state"))
def by_state(spark, sf):
    return I.incidents_by_state(incidents(spark, sf))


PENDING_SQL = """, adds AS (SELECT prints AS n, row_number() OVER (ORDER BY us, seq) AS i FROM actions
  WHERE action = 'disposition' AND value = 'false_positive' AND prints > 0),
run AS (SELECT 0::BIGINT AS i, 0::BIGINT AS pending, 0::BIGINT AS retrains
  UNION ALL SELECT a.i, CASE WHEN r.pending + a.n >= 5 THEN 0 ELSE r.pending + a.n END,
    r.retrains + CASE WHEN r.pending + a.n >= 5 THEN 1 ELSE 0 END FROM run r JOIN adds a ON a.i = r.i + 1)"""


@query("w14_pending_false_positives", acted(PENDING_SQL + """ SELECT 'all' AS store, (SELECT CAST(sum(n) AS BIGINT) FROM adds) AS
  fingerprints, pending, retrains FROM run ORDER BY i DESC LIMIT 1"""))
def pending(spark, sf):
    return I.pending_false_positives(actions(spark, sf), rows_per_piece=500).select(
        "store", "fingerprints", F.col("pending").cast("bigint").alias("pending"), "retrains")


@query("a20_feedback_stats", acted(PENDING_SQL + """ SELECT (SELECT count(*) FROM incidents) AS total_incidents,
  (SELECT count(*) FROM incidents WHERE disposition = 'false_positive') AS false_positive_incidents,
  pending AS pending_fp_fingerprints, retrains AS retrain_count FROM run ORDER BY i DESC LIMIT 1"""))
def feedback(spark, sf):
    return I.feedback_stats(incidents(spark, sf), I.pending_false_positives(actions(spark, sf)))


@query("t6_incidents_list", acted("""SELECT incident_id, owner FROM incidents WHERE state = 'dismissed' AND owner = 'analyst1'
  ORDER BY created_us DESC, incident_id LIMIT 100"""))
def listed(spark, sf):
    return I.list_incidents(incidents(spark, sf), "dismissed", "analyst1").select("incident_id", "owner")
