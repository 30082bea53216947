"""Reading, parsing and normalizing lines; rule matching."""

import uuid

from pyspark.sql import functions as F

from vigilog.operators.labelled import rule_test_report, test_rules
from vigilog.operators.normalize import (
    extract_http_method, extract_http_status, extract_ips, extract_paths, extract_pid,
    extract_port, extract_user, get_field, host_fallback,
)
from vigilog.operators.parse import decode_pri, parse_logs
from vigilog.operators.rules import apply_rules, enrich_with_matches, match_rules
from vigilog.sources.catalog import RULES
from vigilog.session import job_folder
from vigilog.sources import lines as sources
from vigilog.sources.lines import frame_lines
from workload.base import (
    REFERENCE_YEAR, ev, events, hits, log_lines, query, raw_events, table,
)


def parsed(spark, sf):
    return parse_logs(log_lines(spark, sf), reference_year=REFERENCE_YEAR)


@query("s1_read_logs", ev("""SELECT event_id, raw, 'gw-' || (id % 3) AS source_host FROM ev"""))
def read_logs(spark, sf):
    lines = log_lines(spark, sf).select(
        "event_id", F.concat("raw", F.lit("\r\n")).alias("value"),
        F.col("source_host").alias("_sender"), "ingested_at")
    rows = frame_lines(lines, "tcp_json", F.col("_sender"))
    return rows.select(F.col("event_id").cast("string").alias("event_id"), "raw", "source_host")


@query("s1_line_identity", ev("""SELECT log_source, 2 * count(*) AS lines, 2 * count(*) AS ids FROM ev GROUP BY 1"""))
def identity(spark, sf):
    """Files that hold every line twice, read back and parsed: as many events as lines."""
    path = f"{job_folder(spark)}/lines-{uuid.uuid4().hex}"
    raw = log_lines(spark, sf).select("raw")
    raw.unionAll(raw).write.text(path)
    found = parse_logs(sources.read_logs(spark, path), reference_year=REFERENCE_YEAR)
    return found.groupBy("log_source").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("event_id").alias("ids"))


@query("p1_parse_logs", ev("""SELECT event_id, log_source, us, tz_offset_min, message FROM ev"""))
def parse(spark, sf):
    return parsed(spark, sf).select(
        "event_id", "log_source", F.unix_micros("timestamp").alias("us"),
        F.col("tz_offset_min"), "message")


@query("p2_rfc5424", ev("""SELECT event_id, us, host, program, pid, facility, severity, message,
  CASE WHEN id % 2 = 0 THEN k END AS sd_k, CASE WHEN id % 2 = 0 THEN event_id END AS sd_seq
  FROM ev WHERE fmt = 0"""))
def rfc5424(spark, sf):
    rows = parsed(spark, sf).where("log_source = 'syslog_rfc5424'")
    return rows.select(
        "event_id", F.unix_micros("timestamp").alias("us"), "host", "program", "pid", "facility",
        "severity", "message", F.col("fields")["k"].alias("sd_k"),
        F.col("fields")["seq"].alias("sd_seq"))


@query("p3_rfc3164", ev("""SELECT event_id, us, host, program, pid, facility, severity, message
  FROM ev WHERE fmt = 1"""))
def rfc3164(spark, sf):
    return parsed(spark, sf).where("log_source = 'syslog_rfc3164'").select(
        "event_id", F.unix_micros("timestamp").alias("us"), "host", "program", "pid", "facility",
        "severity", "message")


@query("p4_cef", ev("""SELECT event_id, 'Acme' AS vendor, program, event_id AS signature_id, message,
  CAST(id % 10 AS VARCHAR) AS cef_severity, source_ip AS src, dest_ip AS dst,
  CAST(source_port AS VARCHAR) AS spt, CAST(dest_port AS VARCHAR) AS dpt,
  'blocked by policy' AS act FROM ev WHERE fmt = 2"""))
def cef(spark, sf):
    f = F.col("fields")
    return parsed(spark, sf).where("log_source = 'cef'").select(
        "event_id", f["device_vendor"].alias("vendor"), "program", f["signature_id"]
        .alias("signature_id"), "message", f["cef_severity"].alias("cef_severity"),
        f["source_ip"].alias("src"), f["dest_ip"].alias("dst"), f["source_port"].alias("spt"),
        f["dest_port"].alias("dpt"), f["act"].alias("act"))


@query("p5_json", ev("""SELECT event_id, us, host, program, pid, severity, message,
  '{"id":' || u || '}' AS user_json FROM ev WHERE fmt = 3"""))
def json_lines(spark, sf):
    return parsed(spark, sf).where("log_source = 'json'").select(
        "event_id", F.unix_micros("timestamp").alias("us"), "host", "program", "pid", "severity",
        "message", F.col("fields")["user"].alias("user_json"))


@query("p6_decode_pri", ev("""SELECT facility, severity, count(*) AS n FROM ev WHERE fmt IN (0, 1)
  GROUP BY facility, severity"""))
def pri(spark, sf):
    facility, severity = decode_pri(F.regexp_extract("raw", r"^<(\d+)>", 1))
    rows = log_lines(spark, sf).where("raw like '<%'")
    return rows.groupBy(facility.alias("facility"), severity.alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p7_normalize", ev("""SELECT event_id, us, host, program, pid, log_source, source_ip, dest_ip,
  source_port, dest_port, username, file_paths, http_method, http_status, tags FROM ev"""))
def normalized(spark, sf):
    f = F.col("fields")
    return raw_events(spark, sf).select(
        "event_id", F.unix_micros("timestamp").alias("us"), "host", "program", "pid", "log_source",
        "source_ip", "dest_ip", F.col("source_port").cast("bigint").alias("source_port"),
        F.col("dest_port").cast("bigint").alias("dest_port"), f["username"].alias("username"),
        f["file_paths"].alias("file_paths"), f["http_method"].alias("http_method"),
        f["http_status"].alias("http_status"), F.array_join("tags", ",").alias("tags"))


IPV4_RE2 = r"\b((?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?))\b"


@query("p8_extract_ips", f"""SELECT doc_id, len(regexp_extract_all(text, '{IPV4_RE2}', 1)) AS ips,
  regexp_extract_all(text, '{IPV4_RE2}', 1)[1] AS first_ip,
  regexp_extract_all(text, '{IPV4_RE2}', 1)[2] AS second_ip FROM documents""")
def ips(spark, sf):
    found = extract_ips(F.col("text"))
    return table(spark, sf, "documents").withColumn("_ips", found).select(
        "doc_id", F.size("_ips").cast("bigint").alias("ips"),
        F.try_element_at("_ips", F.lit(1)).alias("first_ip"),
        F.try_element_at("_ips", F.lit(2)).alias("second_ip"))


@query("p9_extract_port", ev("""SELECT event_id, CASE WHEN ty IN ('error', 'signup') THEN 22 + id % 1000 END AS port
  FROM ev"""))
def ports(spark, sf):
    return events(spark, sf).select(
        "event_id", extract_port(F.col("message")).cast("bigint").alias("port"))


@query("p10_extract_user", r"""SELECT doc_id, CASE WHEN length(w) < 64 AND w NOT IN ('from', 'by', 'for') AND w <> ''
  THEN w END AS username FROM (SELECT doc_id, regexp_extract(text,
  '(?i)(?:user|username|for user|invalid user|for)[\s\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+([A-Za-z0-9_\.\-@]+)', 1) AS w FROM documents)""")
def users(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract_user(F.col("text")).alias("username"))


@query("p11_extract_pid", ev("""SELECT event_id, CASE WHEN ty = 'purchase' THEN id % 5000 + 1 END AS pid FROM ev"""))
def pids(spark, sf):
    return events(spark, sf).select("event_id", extract_pid(F.col("message")).alias("pid"))


@query("p12_extract_paths", r"""SELECT page_id, array_to_string(regexp_extract_all(html, '(?:/[\p{L}\p{M}\p{N}_\.\-]+){2,}')[1:5], ' ') AS paths
  FROM pages""")
def paths(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(extract_paths(F.col("html")), " ").alias("paths"))


@query("p13_extract_http", ev("""SELECT http_method, CAST(http_status AS INT) AS http_status, count(*) AS n FROM ev
  GROUP BY ALL"""))
def http(spark, sf):
    return events(spark, sf).groupBy(
        extract_http_method(F.col("message")).alias("http_method"),
        extract_http_status(F.col("message")).alias("http_status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p14_tag_events", ev("""SELECT unnest(string_split(tags, ',')) AS tag, count(*) AS n FROM ev
  WHERE tags <> '' GROUP BY tag"""))
def tags(spark, sf):
    return raw_events(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"))


@query("p15_host_fallback", ev("""SELECT host, count(*) AS n FROM ev GROUP BY host"""))
def hosts(spark, sf):
    return parsed(spark, sf).groupBy(
        host_fallback(F.col("host"), F.col("source_host")).alias("host")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p16_get_field", ev("""SELECT event_id, program, replace(tags, ',', ' ') AS tags, username,
  CASE WHEN fmt = 2 THEN 'blocked by policy' END AS act FROM ev"""))
def fields(spark, sf):
    rows = raw_events(spark, sf)
    return rows.select(
        "event_id", get_field(rows, "program").alias("program"),
        get_field(rows, "tags").alias("tags"),
        get_field(rows, "fields.username").alias("username"), get_field(rows, "act").alias("act"))


# -- rules -----------------------------------------------------------------------------------

def _rule(detection: dict, title: str = "r") -> list[dict]:
    return [dict(id=title, title=title, level="low", tags=[], detection=detection)]


def _counted(spark, sf, detection, df=None):
    rows = match_rules(df if df is not None else events(spark, sf), _rule(detection))
    return rows.where(F.size("fired") > 0).select("event_id")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.col("text").alias("message"),
        F.lit("").alias("raw"), "lang", "source",
        F.create_map(F.lit("lang"), "lang").alias("fields"))


@query("f1_keywords", ev("""SELECT event_id FROM ev WHERE contains(lower(message), 'port scan')
  OR contains(lower(raw), 'port scan') OR contains(lower(message), 'act=blocked')
  OR contains(lower(raw), 'act=blocked')"""))
def keywords(spark, sf):
    return _counted(spark, sf, {"k": ["Port SCAN", "act=blocked"], "condition": "k"})


@query("f2_contains", """SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents
  WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')""")
def contains(spark, sf):
    return _counted(spark, sf, {"g": {"message|contains": ["License", "password"]},
                                "condition": "g"}, _documents(spark, sf))


@query("f3_startswith", """SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents
  WHERE starts_with(lower(text), 'the') OR starts_with(lower(text), 'is')""")
def startswith(spark, sf):
    return _counted(spark, sf, {"g": {"message|startswith": ["The", "IS"]}, "condition": "g"},
                    _documents(spark, sf))


@query("f4_endswith", """SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents
  WHERE ends_with(lower(text), 'the.') OR ends_with(lower(source), '3')""")
def endswith(spark, sf):
    docs = _documents(spark, sf)
    return _counted(spark, sf, {"a": {"message|endswith": "THE."}, "b": {"source|endswith": 3},
                                "condition": "a or b"}, docs)


@query("f5_regex", r"""SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents
  WHERE regexp_matches(text, '(?i)\b[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}\b')""")
def regex(spark, sf):
    pattern = r"\b[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}\b"
    return _counted(spark, sf, {"g": {"message|re": [pattern, "([broken"]}, "condition": "g"},
                    _documents(spark, sf))


@query("f6_exact", """SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents
  WHERE lower(lang) IN ('en', 'fr')""")
def exact(spark, sf):
    return _counted(spark, sf, {"g": {"fields.lang": ["EN", "fr"]}, "condition": "g"},
                    _documents(spark, sf))


@query("f7_group_and", ev("""SELECT event_id FROM ev WHERE contains(lower(message), 'user')
  AND lower(log_source) = 'json' AND starts_with(lower(host), 'app')"""))
def group_and(spark, sf):
    return _counted(spark, sf, {"g": {"message|contains": "user", "log_source": "json",
                                      "host|startswith": "app"}, "condition": "g"})


@query("f8_condition", ev("""SELECT event_id FROM ev WHERE (contains(lower(message), 'password')
  AND NOT lower(log_source) = 'cef') OR (coalesce(lower(program) = 'nginx', false)
  AND NOT coalesce(contains(lower(facility), 'local'), false))"""))
def condition(spark, sf):
    return _counted(spark, sf, {
        "pw": ["password"], "not-cef": {"log_source": "cef"}, "web": {"program": "nginx"},
        "loc": {"facility|contains": "local"}, "unused": ["zzz"],
        "condition": "(pw AND not not-cef) or (web and NOT (loc or missing))"})


@query("f9_quantifiers", ev("""SELECT event_id FROM ev WHERE (contains(lower(message), 'failed')
  OR contains(lower(message), 'accepted')) AND (lower(log_source) = 'json'
  AND starts_with(lower(host), 'app-01'))"""))
def quantifiers(spark, sf):
    return _counted(spark, sf, {
        "kw_a": {"message|contains": "failed"}, "kw_b": {"message|contains": "accepted"},
        "at_a": {"log_source": "json"}, "at_b": {"host|startswith": "app-01"},
        "condition": "1 of kw_* and all of at_*"})


@query("f10_apply_rules", hits("""SELECT event_id, rule_id, title, level, groups AS matched_groups FROM hits"""))
def rules(spark, sf):
    return apply_rules(raw_events(spark, sf), RULES).select(
        "event_id", "rule_id", "title", "level",
        F.array_join("matched_groups", ",").alias("matched_groups"))


def numbered_rules(n: int) -> list[dict]:
    """Rules on a user each, unless the line names a port or the end of an address."""
    return [{"id": f"n{i}", "title": f"N{i}", "level": "low", "tags": [], "detection": {
        "who": {"message|contains": [f"User{i} ", f"user{i}0 "]}, "where": [f"port {22 + i} ", f"0.{i % 250} "],
        "condition": "who and not where"}} for i in range(n)]


@query("f10_thousand_rules", ev("""SELECT 'N' || i AS title, count(*) AS n FROM ev, (SELECT unnest(range(1000)) AS i)
  WHERE (contains(lower(message), 'user' || i || ' ') OR contains(lower(message), 'user' || i || '0 '))
    AND NOT (contains(lower(message), 'port ' || (22 + i) || ' ') OR contains(lower(raw), 'port ' || (22 + i) || ' ')
      OR contains(lower(message), '0.' || (i % 250) || ' ') OR contains(lower(raw), '0.' || (i % 250) || ' '))
  GROUP BY i"""))
def thousand_rules(spark, sf):
    return apply_rules(raw_events(spark, sf), numbered_rules(1000)).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("f11_enrich_with_matches", hits("""SELECT ev.event_id,
  coalesce(a.titles, '') AS sigma_matches, concat_ws(',', nullif(ev.tags, ''), b.tags) AS tags FROM ev
  LEFT JOIN (SELECT event_id, string_agg(title, ',' ORDER BY rule_number) AS titles FROM hits GROUP BY event_id) a
    USING (event_id)
  LEFT JOIN (SELECT event_id, string_agg(t, ',' ORDER BY pos) AS tags FROM (
    SELECT event_id, t, min(pos) AS pos FROM (
      SELECT event_id, 'sigma:' || replace(lower(title), ' ', '_')[1:40] AS t, rule_number * 2 AS pos FROM hits
      UNION ALL SELECT event_id, 'level:' || level, rule_number * 2 + 1 FROM hits) GROUP BY event_id, t)
    GROUP BY event_id) b USING (event_id)"""))
def enriched(spark, sf):
    return enrich_with_matches(raw_events(spark, sf), RULES).select(
        "event_id", F.array_join("sigma_matches", ",").alias("sigma_matches"),
        F.array_join("tags", ",").alias("tags"))


@query("a14_labelled_tests", ev("""SELECT title, count(*) AS tests, count(*) FILTER (WHERE ok) AS passed,
  count(*) FILTER (WHERE NOT ok) AS failed FROM (
  SELECT 'SSH Brute Force Attempt' AS title, (id % 11 <> 0) AS ok FROM ev UNION ALL
  SELECT 'Port Scan Detected', true FROM ev) GROUP BY title"""))
def labelled(spark, sf):
    lines = log_lines(spark, sf).join(
        table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    brute = lines.select(
        F.concat(F.lit("b"), "event_id").alias("case_id"),
        F.lit("SSH Brute Force Attempt").alias("title"),
        # every eleventh label is wrong on purpose
        ((F.col("event_type") == "error") == (F.col("event_id") % 11 != 0)).alias("should_match"),
        "raw", "ingested_at")
    scan = lines.select(
        F.concat(F.lit("s"), "event_id").alias("case_id"), F.lit("Port Scan Detected").alias("title"),
        (F.col("event_type") == "click").alias("should_match"), "raw", "ingested_at")
    return rule_test_report(test_rules(brute.unionByName(scan), RULES, REFERENCE_YEAR))
