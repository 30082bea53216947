"""Sources, windows, chains, alerts, selections and reports."""

import uuid

from pyspark.sql import functions as F

from vigilog.functions.hashing import fingerprint, stix_id
from vigilog.functions.severity import ml_severity, severity_rank, stix_confidence
from vigilog.functions.stix import base64_text, stix_pattern
from vigilog.operators import reports
from vigilog.operators.alerts import (
    by_severity, filter_alerts, first_alert_of_event, recent_alerts, select_alerts,
    severity_at_least, technique_ids, with_chain_tags,
)
from vigilog.operators.dedup import dedup_gap, throttle
from vigilog.operators.incidents import auto_incident, incident_members, merge_incident
from vigilog.operators.normalize import source_key
from vigilog.operators.sequence import match_sequences, step_matches, window_rows
from vigilog.session import job_folder, with_position
from vigilog.sources.catalog import CHAINS
from vigilog.sources.events import (
    event_count, read_events, recent_events, retain_newest, search_events, store_rows, write_events,
)
from vigilog.sources.sinks import stix_bundles, write_alert_log
from workload.base import (
    LOCK_SECONDS, LONG_CHAINS, RANK_SQL, alerted, alerts, chain_signals, ev, events, fired, fires,
    hits, query, rule_signals, signalled, signals, stepped, table, wide,
)

DAY_US = 86_400_000_000


# -- sources, windows, sequences -------------------------------------------------------------

@query("w1_source_key", ev("SELECT source_ip AS source_key, count(*) AS n FROM ev GROUP BY ALL"))
def keys(spark, sf):
    return events(spark, sf).groupBy(source_key().alias("source_key")).agg(
        F.count(F.lit(1)).alias("n"))


@query("w2_sliding_window", ev("""SELECT a.event_id, least(count(*), 7) AS window_count
  FROM ev a JOIN ev b ON a.source_ip = b.source_ip AND b.us >= a.us - 172800000000
    AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)) GROUP BY a.event_id"""))
def sliding(spark, sf):
    return window_rows(events(spark, sf).select("event_id", "source_key", "us"), ["source_key"],
                       "us", ["event_id"], 2 * 86400, cap=7).select("event_id", "window_count")


@query("w3_step_match", ev("""SELECT event_id, ty = 'purchase' AS escalation, ty = 'error' AS failed,
  coalesce(program = 'nginx', false) AS web FROM ev"""))
def steps(spark, sf):
    return events(spark, sf).select(
        "event_id",
        step_matches(["Privilege Escalation", "uid=0"]).alias("escalation"),
        step_matches(["auth:failure"]).alias("failed"), step_matches(["NGINX"]).alias("web"))


def _typed(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("w4_match_sequence", """SELECT DISTINCT c.event_id, c.user_id, 'error-purchase' AS chain_id
  FROM events c JOIN events a ON a.user_id = c.user_id AND a.event_type = 'error'
    AND epoch_us(a.ts) >= epoch_us(c.ts) - 86400000000
  JOIN events b ON b.user_id = c.user_id AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= c.ts
  UNION ALL SELECT DISTINCT c.event_id, c.user_id, 'three-errors' FROM events c
  JOIN events a ON a.user_id = c.user_id AND a.event_type = 'error'
    AND epoch_us(a.ts) >= epoch_us(c.ts) - 172800000000
  JOIN events b ON b.user_id = c.user_id AND b.event_type = 'error' AND b.ts > a.ts
  JOIN events d ON d.user_id = c.user_id AND d.event_type = 'error' AND d.ts > b.ts AND d.ts <= c.ts""")
def sequences(spark, sf):
    kind = F.col("event_type")
    chains = [("error-purchase", 86400, [kind == "error", kind == "purchase"]),
              ("three-errors", 2 * 86400, [kind == "error"] * 3)]
    return match_sequences(_typed(spark, sf), ["user_id"], "us", ["event_id"], chains,
                           throttled=False, evidence=False).select("event_id", "user_id", "chain_id")


@query("w5_step_evidence", stepped("""SELECT chain_id, source_key, event_id AS trigger_id, n AS step,
  step_event FROM taken WHERE n > 0"""))
def evidence(spark, sf):
    return fires(spark, sf).select(
        "chain_id", "source_key", F.col("event_id").alias("trigger_id"),
        F.posexplode("steps").alias("step", "_at")).select(
        "chain_id", "source_key", "trigger_id", (F.col("step") + 1).alias("step"),
        F.col("_at.event_id").alias("step_event"))


@query("w6_fire_throttle", """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  w AS (SELECT user_id, event_id, us, i, us AS last_us, true AS kept FROM n WHERE i = 1
    UNION ALL SELECT n.user_id, n.event_id, n.us, n.i,
      CASE WHEN n.us - w.last_us >= 86400000000 THEN n.us ELSE w.last_us END, n.us - w.last_us >= 86400000000
    FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
  SELECT user_id, event_id, us FROM w WHERE kept""")
def throttled(spark, sf):
    return throttle(_typed(spark, sf).select("user_id", "event_id", "us"), ["user_id"], "us",
                    86400, ["event_id"])


@query("w7_chain_duration", fired("""SELECT chain_id, source_key, event_id,
  (us - first_us) / 1000000.0 AS duration_seconds FROM fires"""))
def durations(spark, sf):
    return fires(spark, sf).select(
        "chain_id", "source_key", "event_id",
        ((F.col("us") - F.col("first_us")) / 1_000_000).alias("duration_seconds"))


@query("w8_chain_tags", fired("""SELECT event_id, string_agg(chain_id, ',' ORDER BY chain_id) AS chains
  FROM fires GROUP BY event_id"""))
def chain_tags(spark, sf):
    rows = with_chain_tags(events(spark, sf), fires(spark, sf), LONG_CHAINS)
    mine = F.filter("tags", lambda t: F.startswith(t, F.lit("correlated:")))
    return rows.where(F.size(mine) > 0).select(
        "event_id", F.replace(F.array_join(mine, ","), F.lit("correlated:"), F.lit(""))
        .alias("chains"))


@query("w9_builtin_chains", fired("""SELECT c.chain_id, c.severity, c.step_names, count(f.us) AS fires
  FROM chains c LEFT JOIN fires f USING (chain_id) GROUP BY ALL"""))
def builtin(spark, sf):
    from vigilog.sources.catalog import chains_table

    counts = fires(spark, sf).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    return chains_table(spark, CHAINS).join(counts, "chain_id", "left").select(
        "chain_id", "severity", F.array_join("step_names", ",").alias("step_names"),
        F.coalesce("n", F.lit(0)).alias("fires"))


@query("w10_alert_dedup", """WITH m AS (SELECT *, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts))
    OVER p < 14400000000 THEN 0 ELSE 1 END AS opens FROM events
    WINDOW p AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM m)
  SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS hit_count, min(us) AS first_us,
    max(us) AS last_us FROM i GROUP BY user_id, event_type, island""")
def deduped(spark, sf):
    return dedup_gap(_typed(spark, sf), ["user_id", "event_type"], "us", 4 * 3600, ["event_id"]
                     ).select("user_id", "event_type", "event_id", "hit_count", "first_us", "last_us")


@query("w11_first_alert", alerted("""SELECT event_id, alert_id FROM (SELECT *, row_number() OVER (
  PARTITION BY event_id ORDER BY kind, title, alert_id) AS r FROM alerts) WHERE r = 1"""))
def first_alert(spark, sf):
    return first_alert_of_event(alerts(spark, sf))


@query("w12_replay", alerted("""SELECT a.alert_id, t.n - 1 AS index, string_split(t.step_names, ',')[t.n] AS step_name,
  k.message[1:120] AS message, CASE WHEN a.duration_seconds <> 0 THEN CAST(round(a.us - a.duration_seconds * 1000000
    + a.duration_seconds * 1000000 * (t.n - 1) / (length(t.letters) - 1)) AS BIGINT) ELSE a.us END AS step_us
  FROM alerts a JOIN taken t ON t.chain_id = a.chain_id AND t.source_key = a.source_key AND t.us = a.us
  JOIN keyed k ON k.event_id = t.step_event WHERE t.n > 0 AND a.alert_type = 'correlation'"""))
def replayed(spark, sf):
    return reports.replay(alerts(spark, sf)).select(
        "alert_id", "index", "step_name", "message", "step_us")


@query("w13_threat_timeline", alerted("""SELECT r - 1 AS position, 'T+' || (r - 1) * 30 || 's' AS label,
  upper(alert_type) AS alert_type, title, source_key, us FROM (SELECT *, row_number() OVER (ORDER BY us, alert_id)
  AS r FROM alerts) WHERE r <= 15"""))
def timeline(spark, sf):
    return reports.threat_timeline(alerts(spark, sf))


# -- alerts ----------------------------------------------------------------------------------

SIGNAL_COLUMNS = ("alert_type, title, severity, source_key, event_id, event_message, us, sigma_rule_id, "
                  "chain_id, mitre_tactic, techniques, fingerprint")


def _signal_columns(df):
    return df.select(
        "alert_type", "title", "severity", "source_key", "event_id", "event_message", "us",
        "sigma_rule_id", "chain_id", "mitre_tactic",
        F.array_join("mitre_techniques", ",").alias("techniques"), "fingerprint")


@query("l1_alerts_from_matches", signalled(f"""SELECT {SIGNAL_COLUMNS.replace('techniques', "coalesce(techniques, '') AS techniques")}
  FROM signals WHERE alert_type = 'sigma'"""))
def from_matches(spark, sf):
    return _signal_columns(rule_signals(spark, sf))


@query("l2_alerts_from_chains", signalled(f"""SELECT {SIGNAL_COLUMNS}, duration_seconds FROM signals
  WHERE alert_type = 'correlation'"""))
def from_chains(spark, sf):
    rows = chain_signals(spark, sf)
    return _signal_columns(rows).join(
        rows.select("chain_id", "source_key", "us", "duration_seconds"),
        ["chain_id", "source_key", "us"])


@query("l4_alerts", alerted("""SELECT alert_id, alert_type, title, severity, source_key, us, hit_count, first_us,
  last_us, fingerprint FROM alerts"""))
def merged(spark, sf):
    return alerts(spark, sf).select(
        "alert_id", "alert_type", "title", "severity", "source_key", "us", "hit_count", "first_us",
        "last_us", "fingerprint")


@query("u1_union_signals", signalled("""SELECT alert_type, severity, count(*) AS n FROM signals GROUP BY ALL"""))
def union(spark, sf):
    return signals(spark, sf).groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("f12_severity_filter", signalled(f"""SELECT severity, count(*) AS n FROM signals WHERE {RANK_SQL} >= 4
  GROUP BY severity"""))
def severe(spark, sf):
    return severity_at_least(signals(spark, sf), "high").groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"))


@query("f13_search_events", ev("""SELECT event_id FROM ev WHERE contains(lower(message), 'web-01')
  OR contains(lower(host), 'web-01') OR contains(source_ip, 'web-01')"""))
def search(spark, sf):
    return search_events(events(spark, sf), "WEB-01").select("event_id")


@query("f14_filter_alerts", wide(alerted("""SELECT alert_id FROM alerts WHERE severity = 'high' AND alert_type = 'sigma'""")))
def filtered(spark, sf):
    return filter_alerts(alerts(spark, sf), "high", "sigma").select("alert_id")


@query("f16_select_alerts", wide(alerted("""SELECT alert_id FROM alerts WHERE alert_id[1:2] IN (
  SELECT fingerprint[1:2] FROM alerts WHERE title LIKE 'Port Scan%' AND us % 7 = 0)
  OR fingerprint IN (SELECT fingerprint FROM alerts WHERE alert_type = 'correlation')""")))
def selected(spark, sf):
    rows = alerts(spark, sf)
    wanted = rows.where("title like 'Port Scan%' and us % 7 = 0").select(
        F.substring("fingerprint", 1, 2).alias("id")).unionByName(
        rows.where("alert_type = 'correlation'").select(F.col("fingerprint").alias("id")))
    return select_alerts(rows, wanted).select("alert_id")


@query("t1_recent_events", ev("""SELECT event_id, host, message, 0 AS has_alert FROM ev WHERE host = 'web-03'
  ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 10"""))
def newest_events(spark, sf):
    return recent_events(store_rows(events(spark, sf)), host="web-03", has_alert=False, limit=50,
                         offset=10).select("event_id", "host", "message", "has_alert")


@query("t2_recent_alerts", alerted("""SELECT alert_id, us FROM alerts WHERE severity = 'medium'
  ORDER BY us DESC, alert_id LIMIT 1000 OFFSET 5"""))
def newest_alerts(spark, sf):
    return recent_alerts(alerts(spark, sf), 1000, 5, severity="medium").select("alert_id", "us")


@query("t3_alerts_by_severity", alerted(f"""SELECT alert_id, severity, {RANK_SQL} AS rank, us, row_number() OVER (
  ORDER BY {RANK_SQL} DESC, us DESC, alert_id) AS position FROM alerts"""))
def worst_first(spark, sf):
    """All alerts, most severe first, with their place in that order."""
    return with_position(by_severity(alerts(spark, sf)).select(
        "alert_id", "severity", severity_rank("severity").alias("rank"), "us"))


@query("t7_auto_incident", alerted("""SELECT alert_id FROM alerts WHERE alert_type = 'correlation'
  AND severity IN ('critical', 'high') UNION ALL SELECT alert_id FROM (SELECT alert_id FROM alerts
  ORDER BY us DESC, alert_id LIMIT 5) WHERE NOT EXISTS (SELECT 1 FROM alerts WHERE alert_type = 'correlation'
  AND severity IN ('critical', 'high'))"""))
def auto(spark, sf):
    return auto_incident(alerts(spark, sf)).select("alert_id")


@query("t8_event_count", "SELECT count(*) AS events FROM events")
def counted(spark, sf):
    return event_count(events(spark, sf))


@query("s5_event_store", ev("""SELECT event_id, host, message[1:512] AS message, 0 AS has_alert,
  CAST(make_timestamp(us) AS DATE) AS event_date FROM ev"""))
def stored(spark, sf):
    path = f"{job_folder(spark)}/store-{uuid.uuid4().hex}"
    write_events(events(spark, sf), path)
    return read_events(spark, path).select(
        "event_id", "host", "message", "has_alert", "event_date")


@query("s6_retain_newest", """SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 777""")
def retained(spark, sf):
    return retain_newest(_typed(spark, sf), 777, "us", ["event_id"]).select("event_id")


@query("s3_alert_log", alerted("""SELECT CAST(make_timestamp(us) AS DATE) AS alert_date, count(*) AS n
  FROM alerts GROUP BY ALL"""))
def alert_log(spark, sf):
    path = f"{job_folder(spark)}/log-{uuid.uuid4().hex}"
    write_alert_log(alerts(spark, sf), path)
    return spark.read.schema("alert_id string, alert_date date").json(path).groupBy("alert_date").agg(
        F.count(F.lit(1)).alias("n"))


@query("s4_stix_bundles", alerted("""SELECT alert_id, 'bundle--' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-'
  || d[17:20] || '-' || d[21:32] AS bundle_id, 3 AS objects, title AS name, CASE severity WHEN 'critical' THEN 95
  WHEN 'high' THEN 80 WHEN 'medium' THEN 60 WHEN 'low' THEN 40 END AS confidence, hit_count AS sighted
  FROM (SELECT *, sha256('bundle:' || alert_id) AS d FROM alerts)"""))
def bundles(spark, sf):
    rows = stix_bundles(alerts(spark, sf))
    v = "value"
    return rows.select(
        "alert_id", F.get_json_object(v, "$.id").alias("bundle_id"),
        F.json_array_length(F.get_json_object(v, "$.objects")).alias("objects"),
        F.get_json_object(v, "$.objects[0].name").alias("name"),
        F.get_json_object(v, "$.objects[0].confidence").cast("int").alias("confidence"),
        F.get_json_object(v, "$.objects[1].count").cast("bigint").alias("sighted"))


# -- scalar functions ------------------------------------------------------------------------

@query("x1_text_cuts", ev("""SELECT event_id, lower(host) AS host, message[1:20] AS head FROM ev"""))
def cuts(spark, sf):
    return events(spark, sf).select("event_id", F.lower("host").alias("host"),
                                    F.substring("message", 1, 20).alias("head"))


@query("x2_fingerprint", """SELECT c_custkey, sha256('sigma:' || c_name || ':' || c_mktsegment)[1:16] AS print FROM customer""")
def prints(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", fingerprint(F.lit("sigma"), F.col("c_name"), F.col("c_mktsegment")).alias("print"))


@query("x3_stix_id", """SELECT c_custkey, 'indicator--' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20]
  || '-' || d[21:32] AS id FROM (SELECT c_custkey, sha256('indicator:' || c_name) AS d FROM customer)""")
def ids(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", stix_id("indicator", F.col("c_name")).alias("id"))


@query("x4_base64", "SELECT item_id, base64(encode(text)) AS b64 FROM benchmark")
def encoded(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.replace(
        base64_text(F.col("text")), F.lit("\r\n"), F.lit("")).alias("b64"))


@query("x5_ml_severity", """SELECT CASE WHEN l_discount * 10 >= 0.85 THEN 'high' WHEN l_discount * 10 >= 0.70 THEN 'medium'
  ELSE 'low' END AS severity, count(*) AS n FROM lineitem GROUP BY ALL""")
def score_severity(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        ml_severity(F.col("l_discount") * 10).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("x6_confidence", wide(signalled("""SELECT CASE severity WHEN 'critical' THEN 95 WHEN 'high' THEN 80 WHEN 'medium' THEN 60
  WHEN 'low' THEN 40 WHEN 'informational' THEN 20 ELSE 50 END AS confidence, count(*) AS n FROM signals GROUP BY ALL""")))
def confidence(spark, sf):
    return signals(spark, sf).groupBy(stix_confidence(F.col("severity")).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x7_technique_ids", hits("""SELECT upper(replace(t, 'attack.', '')) AS technique, count(*) AS n FROM (
  SELECT unnest(string_split(tags, ',')) AS t FROM hits) WHERE t LIKE 'attack.t%' GROUP BY ALL"""))
def techniques(spark, sf):
    return rule_signals(spark, sf).select(
        F.explode(technique_ids(F.col("sigma_tags"))).alias("technique")).groupBy("technique").agg(
        F.count(F.lit(1)).alias("n"))


@query("x8_stix_pattern", signalled("""SELECT DISTINCT CASE alert_type WHEN 'sigma' THEN
  '[network-traffic:src_ref.value = ''' || source_key || ''']' ELSE '[network-traffic:src_ref.value = ''' || source_key
  || ''' AND network-traffic:dst_port > 0]' END AS pattern FROM signals"""))
def patterns(spark, sf):
    return signals(spark, sf).select(
        stix_pattern(F.col("alert_type"), F.col("source_key")).alias("pattern")).distinct()


@query("x20_event_json", wide(ev("""SELECT event_id, CASE WHEN source_ip IS NOT NULL THEN CAST(json_extract(j, '$.source_ip') AS VARCHAR) END AS ip FROM (
  SELECT event_id, source_ip, json_object('source_ip', source_ip) AS j FROM ev)""")))
def as_json(spark, sf):
    rows = store_rows(events(spark, sf))
    return rows.select("event_id", F.concat(F.lit('"'), F.get_json_object("payload", "$.source_ip"),
                                            F.lit('"')).alias("ip"))


# -- reports ---------------------------------------------------------------------------------

@query("a1_pipeline_stats", alerted("""SELECT (SELECT count(*) FROM ev) AS events_processed,
  (SELECT count(*) FROM hits) AS sigma_hits, (SELECT count(*) FROM fires) AS chain_alerts, 0 AS ml_anomalies,
  count(*) AS alerts_written, CAST(sum(hit_count - 1) AS BIGINT) AS deduped FROM alerts"""))
def stats(spark, sf):
    return reports.pipeline_stats(events(spark, sf), signals(spark, sf), alerts(spark, sf))


@query("a2_events_per_sec", ev("""SELECT us // 2000000 * 2 AS tick, round(count(*) / 2, 1) AS events_per_sec
  FROM ev GROUP BY ALL"""))
def rate(spark, sf):
    return reports.events_per_second(events(spark, sf), F.col("us"))


@query("a4_alert_stats", wide(alerted(f"""SELECT s.alert_type, coalesce(a.n, 0) AS alerts, coalesce(a.d, 0) AS deduped,
  s.low AS suppressed FROM (SELECT alert_type, count(*) FILTER (WHERE {RANK_SQL} < 2) AS low FROM signals
  GROUP BY alert_type) s LEFT JOIN (SELECT alert_type, count(*) AS n, CAST(sum(hit_count - 1) AS BIGINT) AS d
  FROM alerts GROUP BY alert_type) a USING (alert_type)""")))
def by_type(spark, sf):
    return reports.alert_stats(signals(spark, sf), alerts(spark, sf))


@query("a5_window_load", ev("""SELECT count(*) AS tracked_sources, CAST(sum(n) AS BIGINT) AS buffered_events FROM (
  SELECT source_ip, least(count(*), 500) AS n FROM ev WHERE us >= (SELECT max(us) FROM ev) - 604800000000
  GROUP BY source_ip)"""))
def load(spark, sf):
    return reports.window_load(events(spark, sf), "source_key", "us", 7 * 86400)


@query("a16_executive_counts", alerted("""SELECT count(*) AS total_alerts,
  count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(DISTINCT source_key) AS unique_sources, count(DISTINCT alert_type) AS alert_types FROM alerts"""))
def executive(spark, sf):
    return reports.executive_counts(alerts(spark, sf))


@query("a16_most_severe", alerted(f"""SELECT alert_id, title, severity FROM alerts
  ORDER BY {RANK_SQL} DESC, us, alert_id LIMIT 5"""))
def worst(spark, sf):
    return reports.most_severe(alerts(spark, sf)).select("alert_id", "title", "severity")


@query("a17_cluster_summary", alerted("""SELECT count(*) AS alerts, string_agg(DISTINCT alert_type, ', ' ORDER BY alert_type)
  AS alert_types, string_agg(DISTINCT severity, ', ' ORDER BY severity) AS severities,
  count(DISTINCT source_key) AS sources FROM alerts"""))
def cluster(spark, sf):
    return reports.cluster_summary(alerts(spark, sf))


@query("w13_techniques_seen", alerted("""SELECT DISTINCT unnest(string_split(techniques, ',')) AS technique FROM alerts
  WHERE techniques <> ''"""))
def seen(spark, sf):
    return reports.techniques_seen(alerts(spark, sf))


@query("a21_merge_incident", alerted(f"""SELECT a.source_key, arg_min(title, (us, alert_id)) AS title,
  arg_max(severity, {RANK_SQL}) AS severity, coalesce(string_agg(DISTINCT nullif(mitre_tactic, ''), ' → '
  ORDER BY nullif(mitre_tactic, '')), '') AS mitre_tactic, count(*) AS alerts, coalesce(any_value(t.techniques), '')
  AS techniques FROM alerts a LEFT JOIN (SELECT source_key, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques
  FROM (SELECT source_key, unnest(string_split(techniques, ',')) AS t FROM alerts WHERE techniques <> '')
  GROUP BY source_key) t USING (source_key) GROUP BY a.source_key"""))
def incidents(spark, sf):
    return merge_incident(alerts(spark, sf), "source_key").select(
        "source_key", "title", "severity", "mitre_tactic", "alerts",
        F.array_join("mitre_techniques", ",").alias("techniques"))


@query("a21_incident_members", alerted("SELECT source_key, alert_id, fingerprint FROM alerts"))
def members(spark, sf):
    return incident_members(alerts(spark, sf), "source_key").select(
        "source_key", "alert_id", "fingerprint")
