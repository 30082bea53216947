"""Features, forest scores and what follows from them."""

import uuid

from pyspark.sql import functions as F

from vigilog.functions.features import feature_columns, features, local_clock, top_features
from vigilog.functions.hashing import stable_hash
from vigilog.functions.net import port_bucket
from vigilog.operators.alerts import alerts_from_scores
from vigilog.operators.forest import (
    SAMPLE, TREE_SCHEMA, Baseline, anomaly_score, average_path, exact_quantiles, mean_vector, score, score_stats,
    without_false_positives,
)
from vigilog.values import ANOMALY_THRESHOLD, FEATURE_NAMES
from workload.base import (
    ev, events, hits, model, query, rule_signals, score_signals, scored, stage, table, wide,
)

FEATURES_SQL = """clock AS (SELECT *, us + tz_offset_min * 60000000::BIGINT AS lus,
    coalesce(lower(program), '') AS prog_, coalesce(lower(severity), '') AS sev, coalesce(lower(facility), '') AS fac FROM ev),
  tagged AS (SELECT c.*, CASE WHEN c.tags = '' THEN 0 ELSE len(string_split(c.tags, ',')) END + coalesce(t.n, 0) AS n_tags
    FROM clock c LEFT JOIN (SELECT event_id, count(DISTINCT title) + count(DISTINCT level) AS n FROM hits GROUP BY event_id) t
    USING (event_id)),
  parts AS (SELECT *, lus // 3600000000 % 24 AS hr, lus // 60000000 % 60 AS mi, (lus // 86400000000 + 3) % 7 AS wd FROM tagged),
  feats AS (SELECT event_id, hr / 23 AS hour_of_day, mi / 59 AS minute_of_hour,
    CASE WHEN wd >= 5 THEN 1.0 ELSE 0.0 END AS is_weekend, CASE WHEN hr < 6 OR hr >= 22 THEN 1.0 ELSE 0.0 END AS is_off_hours,
    CASE WHEN hr >= 8 AND hr < 18 AND wd < 5 THEN 1.0 ELSE 0.0 END AS is_business_hours,
    CASE WHEN source_ip <> '' THEN 1.0 ELSE 0.0 END AS has_source_ip,
    CASE WHEN dest_port > 1024 THEN 1.0 ELSE 0.0 END AS is_high_port,
    CASE WHEN dest_port BETWEEN 1 AND 1024 THEN 1.0 ELSE 0.0 END AS is_privileged_port,
    CASE WHEN dest_port > 0 THEN 1.0 ELSE 0.0 END AS has_dest_port,
    CASE WHEN prog_ = '' THEN 0.0 ELSE list_reduce(list_prepend(0::BIGINT, list_transform(string_split(prog_, ''),
      lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 16777215) / 16777215 END AS program_hash_norm,
    CASE WHEN regexp_matches(message, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') THEN 1.0 ELSE 0.0 END AS has_ip_in_message,
    CASE WHEN sev IN ('emerg', 'alert', 'crit', 'err') THEN 1.0 ELSE 0.0 END AS is_error_severity,
    CASE WHEN sev IN ('notice', 'info', 'debug') THEN 1.0 ELSE 0.0 END AS is_info_severity,
    CAST(string_split(source_ip, '.')[1] AS INT) / 255 AS source_ip_octet1,
    CASE WHEN starts_with(source_ip, '10.') THEN 1.0 ELSE 0.0 END AS source_ip_is_rfc1918,
    coalesce(dest_port, 0) / 65535 AS dest_port_norm, coalesce(source_port, 0) / 65535 AS source_port_norm,
    CASE WHEN dest_port IN (20,21,22,23,25,53,80,110,143,443,465,587,993,995) THEN 1.0 ELSE 0.0 END AS is_common_port,
    CASE WHEN dest_port IS NULL THEN 0.0 WHEN dest_port <= 80 THEN 0.1 WHEN dest_port <= 443 THEN 0.2
      WHEN dest_port <= 1024 THEN 0.3 ELSE 0.4 END AS dest_port_bucket,
    CASE log_source WHEN 'syslog_rfc5424' THEN 0.2 WHEN 'syslog_rfc3164' THEN 0.4 WHEN 'cef' THEN 0.6 WHEN 'json' THEN 0.8
      ELSE 1.0 END AS log_source_enc, CASE WHEN prog_ IN ('sshd', 'sudo') THEN 1.0 ELSE 0.0 END AS is_auth_program,
    CASE WHEN prog_ IN ('snort', 'nginx') THEN 1.0 ELSE 0.0 END AS is_network_program,
    CASE WHEN pid IS NULL THEN 0.0 ELSE 1.0 END AS has_pid, least(length(message) / 512, 1) AS message_length_norm,
    CASE WHEN ty IN ('error') THEN 1.0 ELSE 0.0 END AS has_failure_keyword,
    CASE WHEN ty IN ('signup') THEN 1.0 ELSE 0.0 END AS has_success_keyword,
    CASE WHEN ty = 'purchase' THEN 1.0 ELSE 0.0 END AS has_path_in_message,
    CASE sev WHEN 'emerg' THEN 1.0 WHEN 'alert' THEN 0.86 WHEN 'crit' THEN 0.72 WHEN 'err' THEN 0.58 WHEN 'warning' THEN 0.44
      WHEN 'notice' THEN 0.30 WHEN 'info' THEN 0.16 WHEN 'debug' THEN 0.08 ELSE 0.0 END AS severity_enc,
    CASE WHEN fac IN ('auth', 'authpriv') THEN 1.0 WHEN fac = 'kern' THEN 0.9 WHEN fac = 'daemon' THEN 0.7 WHEN fac = 'syslog' THEN 0.6
      WHEN fac = 'user' THEN 0.5 WHEN fac IN ('mail', 'cron') THEN 0.4 WHEN fac = 'ftp' THEN 0.3
      WHEN fac IN ('news', 'lpr', 'uucp') THEN 0.2 WHEN fac LIKE 'local%' THEN 0.1 ELSE 0.0 END AS facility_enc,
    CASE WHEN sev <> '' THEN 1.0 ELSE 0.0 END AS has_severity, least(n_tags / 10, 1) AS tag_count_norm FROM parts)"""

def featured(body: str) -> str:
    return hits("").rstrip() + ",\n" + FEATURES_SQL + "\n" + body


def vectors(spark, sf):
    return stage(spark, sf, "vectors", lambda: features(events(spark, sf), keep=["event_id"]))


@query("m1_features", featured("SELECT event_id, " + ", ".join(
    f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in FEATURE_NAMES) + " FROM feats"))
def all_features(spark, sf):
    return vectors(spark, sf).select("event_id", *[F.round(c, 6).alias(c) for c in FEATURE_NAMES])


@query("a22_mean_vector", featured("SELECT " + ", ".join(
    f"CAST(round(avg({c}), 6) AS DOUBLE) AS {c}" for c in FEATURE_NAMES) + " FROM feats"))
def means(spark, sf):
    return mean_vector(vectors(spark, sf)).select(*[F.round(c, 6).alias(c) for c in FEATURE_NAMES])


@query("a23_score_calibration", """SELECT round(quantile_cont(o_totalprice, 0.01), 4) AS low,
  round(quantile_cont(o_totalprice, 0.99), 4) AS high FROM orders""")
def calibration(spark, sf):
    low, high = exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0.01, 0.99])
    return spark.createDataFrame([(round(low, 4), round(high, 4))], "low double, high double")


@query("x10_port_bucket", """SELECT l_partkey * 37 % 65536 AS port, CASE WHEN p <= 0 THEN 0.0 WHEN p <= 80 THEN 0.1 WHEN p <= 443 THEN 0.2
  WHEN p <= 1024 THEN 0.3 WHEN p <= 3306 THEN 0.4 WHEN p <= 5432 THEN 0.5 WHEN p <= 8080 THEN 0.6 WHEN p <= 8443 THEN 0.7
  WHEN p <= 32768 THEN 0.8 ELSE 0.9 END::DOUBLE AS bucket FROM (SELECT l_partkey, l_partkey * 37 % 65536 AS p FROM lineitem)""")
def buckets(spark, sf):
    port = F.col("l_partkey") * 37 % 65536
    return table(spark, sf, "lineitem").select(port.alias("port"), port_bucket(port).alias("bucket"))


@query("x11_stable_hash", """SELECT c_custkey, round(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''),
  lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 16777215) / 16777215, 9) AS h FROM customer""")
def hashes(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(stable_hash(F.col("c_name")), 9).alias("h"))


@query("x12_clock", ev("""SELECT event_id, (us + tz_offset_min * 60000000::BIGINT) // 3600000000 % 24 AS hour,
  ((us + tz_offset_min * 60000000::BIGINT) // 86400000000 + 3) % 7 AS weekday FROM ev"""))
def clock(spark, sf):
    hour, _, weekday = local_clock(F.col("timestamp"), F.col("tz_offset_min"))
    return events(spark, sf).select("event_id", hour.alias("hour"), weekday.alias("weekday"))


@query("x13_label_codes", featured("""SELECT log_source_enc::DOUBLE AS log_source_enc, severity_enc::DOUBLE AS severity_enc,
  facility_enc::DOUBLE AS facility_enc, count(*) AS n FROM feats GROUP BY ALL"""))
def codes(spark, sf):
    return vectors(spark, sf).groupBy("log_source_enc", "severity_enc", "facility_enc").agg(
        F.count(F.lit(1)).alias("n"))


@query("x14_message_features", r"""SELECT doc_id, least(length(text) / 512, 1) AS len, regexp_matches(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') AS ip
  FROM documents""")
def message_features(spark, sf):
    columns = feature_columns()
    docs = table(spark, sf, "documents").withColumnRenamed("text", "message")
    return docs.select("doc_id", columns["message_length_norm"].alias("len"),
                       (columns["has_ip_in_message"] == 1).alias("ip"))


@query("x19_score_scale", """SELECT l_orderkey, l_linenumber, greatest(least((-0.40 - (-l_discount * 10)) / 0.25, 1), 0)::DOUBLE AS score
  FROM lineitem""")
def scale(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        anomaly_score(-F.col("l_discount") * 10, -0.65, -0.40).alias("score"))


# a baseline for explanations: the mean of each feature, fixed here so that SQL can state it
MEANS = [round(0.1 + (7 * i % 31) / 40, 3) for i in range(len(FEATURE_NAMES))]
TOP_SQL = f"""ranked AS (SELECT event_id, f, d, i, row_number() OVER (PARTITION BY event_id ORDER BY d DESC, i) AS r FROM (
  SELECT event_id, unnest([{', '.join(f"'{n}'" for n in FEATURE_NAMES)}]) AS f,
    unnest([{', '.join(f"abs({n}::DOUBLE - {m}::DOUBLE)" for n, m in zip(FEATURE_NAMES, MEANS))}]) AS d,
    unnest(range({len(FEATURE_NAMES)})) AS i FROM feats))"""


@query("t5_top_features", featured(f""", {TOP_SQL} SELECT event_id, string_agg(f, ',' ORDER BY r) AS features FROM ranked
  WHERE r <= 3 GROUP BY event_id"""))
def top(spark, sf):
    return vectors(spark, sf).select("event_id", F.array_join(F.transform(
        top_features(MEANS, 3), lambda t: t["feature"]), ",").alias("features"))


# -- a small forest that SQL can walk -------------------------------------------------------------

# (feature, threshold, low side, high side), or the path of a leaf
FOREST = [
    ("dest_port_bucket", 0.15, ("severity_enc", 0.5, 5.5, 2.0), ("is_off_hours", 0.5, 7.25, 3.5)),
    ("has_failure_keyword", 0.5, ("message_length_norm", 0.09, 6.0, ("hour_of_day", 0.3, 8.5, 9.25)), ("is_weekend", 0.5, 4.0, 1.5)),
    ("tag_count_norm", 0.25, ("log_source_enc", 0.5, 6.5, 3.0), ("program_hash_norm", 0.4, 2.5, 5.0)),
    ("is_error_severity", 0.5, ("source_ip_octet1", 0.2, 9.0, 4.5), 1.25),
]
LOW, HIGH = -0.85, -0.6


def forest_rows() -> list[tuple]:
    """FOREST as the rows of a table of nodes."""
    rows = []
    for number, root in enumerate(FOREST):
        nodes, work = [None], [(0, root)]
        while work:
            at, node = work.pop()
            if isinstance(node, float):
                nodes[at] = (number, at, -1, 0.0, -1, -1, node)
                continue
            feature, threshold, low, high = node
            nodes[at] = (number, at, FEATURE_NAMES.index(feature), threshold, len(nodes), len(nodes) + 1, 0.0)
            work += [(len(nodes), low), (len(nodes) + 1, high)]
            nodes += [None, None]
        rows += nodes
    return rows


def path_sql(node) -> str:
    if isinstance(node, float):
        return f"{node}::DOUBLE"
    feature, threshold, low, high = node
    return f"CASE WHEN {feature} <= {threshold}::DOUBLE THEN {path_sql(low)} ELSE {path_sql(high)} END"


SCORED_SQL = f"""{TOP_SQL},
  raws AS (SELECT event_id, -pow(2, -(({' + '.join(f'({path_sql(t)})' for t in FOREST)}) / {len(FOREST)}) / {average_path(SAMPLE)!r}::DOUBLE) AS raw
    FROM feats),
  scores AS (SELECT event_id, greatest(least(({HIGH} - raw) / {HIGH - LOW!r}, 1), 0) AS score FROM raws)"""


def walked(body: str) -> str:
    return featured(f", {SCORED_SQL} {body}")


def fixed_scores(spark, sf):
    """Events scored by FOREST, with explanations against MEANS."""
    def build():
        trees = spark.createDataFrame(forest_rows(), TREE_SCHEMA)
        return score(events(spark, sf), Baseline(trees, MEANS, SAMPLE, LOW, HIGH, 1))

    return stage(spark, sf, "fixed_scores", build)


@query("m3_fixed_forest", walked(f"SELECT event_id, round(score, 6)::DOUBLE AS anomaly_score, score >= {ANOMALY_THRESHOLD} AS is_anomalous FROM scores"))
def fixed_forest(spark, sf):
    return fixed_scores(spark, sf).select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomalous")


@query("m4_fixed_flags", walked(f"""SELECT event_id, printf('ml:score:%.2f', score) AS mark FROM scores WHERE score >= {ANOMALY_THRESHOLD}"""))
def fixed_flags(spark, sf):
    flagged_ = fixed_scores(spark, sf).where(F.array_contains("tags", "ml:anomalous"))
    return flagged_.select("event_id", F.explode(F.filter("tags", lambda t: F.startswith(t, F.lit("ml:score:")))).alias("mark"))


@query("m5_fixed_explanations", walked("SELECT event_id, r::INT AS place, f AS feature, round(d, 6)::DOUBLE AS deviation FROM ranked WHERE r <= 5"))
def fixed_explanations(spark, sf):
    rows = fixed_scores(spark, sf).select("event_id", F.posexplode("top_features").alias("p", "t"))
    return rows.select("event_id", (F.col("p") + 1).alias("place"), "t.feature", F.round("t.deviation", 6).alias("deviation"))


@query("a3_fixed_stats", wide(walked(f"""SELECT count(*) AS events_scored, count(*) FILTER (score >= {ANOMALY_THRESHOLD}) AS anomalies_detected,
  round(avg(score), 6)::DOUBLE AS avg_score, round(max(score), 6)::DOUBLE AS max_score FROM scores""")))
def fixed_stats(spark, sf):
    stats_ = score_stats(fixed_scores(spark, sf))
    return stats_.select("events_scored", "anomalies_detected", *[F.round(c, 6).alias(c) for c in ("avg_score", "max_score")])


@query("l3_fixed_alerts", walked(f"""SELECT event_id, source_ip AS source_key, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.7 THEN 'medium'
    ELSE 'low' END AS severity, us, substr(message, 1, 256) AS event_message, round(score, 6)::DOUBLE AS anomaly_score,
    substr(sha256('ml:' || source_ip || ':ml:' || floor(score * 10)::INT), 1, 16) AS fingerprint
  FROM scores JOIN ev USING (event_id) WHERE score >= {ANOMALY_THRESHOLD}"""))
def fixed_alerts(spark, sf):
    return alerts_from_scores(fixed_scores(spark, sf)).select(
        "event_id", "source_key", "severity", "us", "event_message", F.round("anomaly_score", 6).alias("anomaly_score"), "fingerprint")


@query("m2_train_baseline")
def trees(spark, sf):
    return model(spark, sf).trees


@query("m3_score")
def scores(spark, sf):
    return scored(spark, sf).select("event_id", "anomaly_score", "is_anomalous")


@query("m4_flagged")
def flagged(spark, sf):
    return scored(spark, sf).where("is_anomalous").select("event_id", F.array_join("tags", ",").alias("tags"))


@query("m5_explanations")
def explained(spark, sf):
    return scored(spark, sf).select("event_id", F.explode("top_features").alias("t")).select("event_id", "t.*")


@query("a3_score_stats")
def stats(spark, sf):
    return score_stats(scored(spark, sf))


@query("l3_alerts_from_scores")
def score_alerts(spark, sf):
    return score_signals(spark, sf).select("event_id", "title", "severity", "fingerprint", "anomaly_score")


@query("j10_exclude_false_positives", wide(hits("""SELECT event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM hits
  WHERE sha256('sigma:' || source_key || ':' || title)[1:16] < '4')""")))
def kept(spark, sf):
    signals = rule_signals(spark, sf).select("event_id", "fingerprint")
    wrong = signals.where("fingerprint < '4'").select("fingerprint")
    return without_false_positives(events(spark, sf), signals, wrong).select("event_id")


@query("m6_save_load")
def stored_model(spark, sf):
    from vigilog.operators.forest import load_model, save_model, score
    from vigilog.session import job_folder

    path = f"{job_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(model(spark, sf), path)
    return score(events(spark, sf), load_model(spark, path)).select("event_id", "anomaly_score")


@query("m7_retrain_with_feedback")
def retrained(spark, sf):
    from vigilog.operators.forest import retrain_with_feedback, score

    signals = score_signals(spark, sf).select("event_id", "fingerprint")
    wrong = signals.where("fingerprint < '2'").select("fingerprint")
    every = events(spark, sf)
    new, taken = retrain_with_feedback(model(spark, sf), every, signals, wrong, every.count())
    return score(every, new).select("event_id", "anomaly_score", F.lit(taken).alias("taken"))


# -- what must hold of a forest, whatever its trees -----------------------------------------------

@query("m2_forest_bounds", "SELECT 100 AS trees, true AS bounded")
def forest_bounds(spark, sf):
    nodes = model(spark, sf).trees.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.agg(F.count(F.lit(1)).alias("trees"), F.bool_and(F.col("nodes") <= 511).alias("bounded"))


@query("m3_scores_hold", "SELECT count(*) AS events, count(DISTINCT event_id) AS ids, count(*) AS in_range FROM events")
def scores_hold(spark, sf):
    return scored(spark, sf).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"),
        F.count_if(F.col("anomaly_score").between(0, 1)).alias("in_range"))


@query("m4_flags_hold", "SELECT count(*) AS right_flags, count(*) AS right_tags FROM events")
def flags_hold(spark, sf):
    marks = F.array_contains("tags", "ml:anomalous") & F.array_contains(
        "tags", F.concat(F.lit("ml:score:"), F.format_string("%.2f", "anomaly_score")))
    flag = F.col("is_anomalous")
    return scored(spark, sf).agg(
        F.count_if(flag == (F.col("anomaly_score") >= ANOMALY_THRESHOLD)).alias("right_flags"),
        F.count_if(flag == marks).alias("right_tags"))


@query("m5_explanations_hold", "SELECT count(*) AS explained FROM events")
def explanations_hold(spark, sf):
    parts = F.col("top_features")
    falling = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(parts, i)["deviation"] >= F.get(parts, i + 1)["deviation"])
    return scored(spark, sf).agg(F.count_if((F.size(parts) == 5) & falling).alias("explained"))


@query("l3_alerts_hold", "SELECT true AS one_each")
def score_alerts_hold(spark, sf):
    flagged_ids = scored(spark, sf).where("is_anomalous").select("event_id", F.lit(1).alias("a"))
    both = flagged_ids.join(score_signals(spark, sf).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")), "event_id", "full")
    return both.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(1) & F.col("n").eqNullSafe(1)), F.lit(True)).alias("one_each"))


@query("m6_reload_holds", "SELECT count(*) AS same FROM events")
def reload_holds(spark, sf):
    again = stored_model(spark, sf).withColumnRenamed("anomaly_score", "again")
    return scored(spark, sf).select("event_id", "anomaly_score").join(again, "event_id").agg(
        F.count_if(F.col("anomaly_score") == F.col("again")).alias("same"))
