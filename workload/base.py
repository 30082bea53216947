"""Log lines, events and alerts derived from the given tables, and the register of queries."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators.alerts import (
    alerts_from_chains, alerts_from_matches, alerts_from_scores, chain_fires_with_text,
    merge_alerts,
)
from vigilog.operators.forest import score, train_baseline
from vigilog.operators.normalize import normalize, source_key
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import enrich_with_matches
from vigilog.operators.sequence import chain_steps, match_sequences
from vigilog.session import checkpointed, configure, dealt
from vigilog.sources.catalog import CHAINS, RULES

QUERIES: dict = {}
SQL: dict[str, str] = {}

# a source has an event every few hours, so windows and lockouts are stretched to days
STRETCH = 144
LONG_CHAINS = [c | {"window_seconds": c["window_seconds"] * STRETCH} for c in CHAINS]
LOCK_SECONDS = 300 * STRETCH
REFERENCE_YEAR = 2024


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


_stages: dict = {}
_lock = threading.RLock()


def stage(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table several queries start from, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf, name)
    with _lock:
        if key not in _stages:
            configure(spark)
            _stages[key] = checkpointed(build())
        return _stages[key]


SOURCE_IP = (
    "concat(case when user_id % 3 = 0 then '203.' else '10.' end, user_id div 250, "
    "case when user_id % 3 = 0 then '.113.' else '.0.' end, user_id % 250)"
)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, raw, source_host, ingested_at): one line per event, five formats in turn."""
    e = dealt(table(spark, sf, "events"), "event_id").selectExpr(
        "event_id", "user_id", "event_type", "cast(ts as timestamp) as ts",
        f"{SOURCE_IP} as src", "get_json_object(props, '$.k') as k", "22 + event_id % 1000 as port",
        "(event_id * 7) % 192 as pri", "1000 + event_id % 5000 as pid",
        "case event_type when 'error' then 'sshd' when 'signup' then 'sshd' "
        "when 'purchase' then 'sudo' when 'click' then 'snort' else 'nginx' end as prog")
    e = e.selectExpr(
        "*",
        """case event_type
        when 'error' then concat('Failed password for user', user_id, ' from ', src, ' port ', port, ' ssh2')
        when 'signup' then concat('Accepted password for user', user_id, ' from ', src, ' port ', port, ' ssh2')
        when 'purchase' then concat('sudo: user', user_id, ' from ', src, ' : COMMAND=/usr/bin/app as root pid=', event_id % 5000 + 1)
        when 'click' then concat('Port Scan Detected from ', src)
        else concat(src, ' "GET /admin HTTP/1.1" 403') end as msg""",
        """case when event_id % 20 = 0
        then concat(date_format(ts + interval 330 minutes, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+05:30')
        else concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') end as iso""")
    return e.selectExpr(
        "event_id",
        """case event_id % 5
        when 0 then concat('<', pri, '>1 ', iso, ' web-0', user_id % 7, ' ', prog, ' ', pid, ' ID47 ',
          case when event_id % 2 = 0 then concat('[meta k="', k, '" seq="', event_id, '"]') else '-' end, ' ', msg)
        when 1 then concat('<', pri, '>', date_format(ts, 'MMM dd HH:mm:ss'), ' web-0', user_id % 7, ' ',
          prog, '[', pid, ']: ', msg)
        when 2 then concat('CEF:0|Acme|FW|1.0|', event_id, '|', msg, '|', event_id % 10, '|src=', src,
          ' spt=', 1024 + event_id % 60000, ' dst=10.9.0.', event_id % 250, ' dpt=', port, ' act=blocked by policy')
        when 3 then concat('{"timestamp":"', iso, '","host":"app-0', user_id % 7, '","process":"', prog,
          '","pid":', pid, ',"level":"', case event_id % 3 when 0 then 'info' when 1 then 'warn' else 'error' end,
          '","user":{"id":', user_id, '},"message":"', replace(msg, '"', '\\\\"'), '"}')
        else msg end as raw""",
        "concat('gw-', event_id % 3) as source_host", "ts as ingested_at")


def raw_events(spark, sf) -> DataFrame:
    return normalize(parse_logs(log_lines(spark, sf), reference_year=REFERENCE_YEAR))


def events(spark, sf) -> DataFrame:
    """Normalized and rule-tagged events with ``source_key`` and ``us``."""
    return stage(spark, sf, "events", lambda: enrich_with_matches(raw_events(spark, sf), RULES)
                 .drop("fired").withColumn("source_key", source_key())
                 .withColumn("us", F.unix_micros("timestamp")))


def fires(spark, sf) -> DataFrame:
    return stage(spark, sf, "fires", lambda: match_sequences(
        events(spark, sf), ["source_key"], "us", ["event_id"], chain_steps(LONG_CHAINS),
        lock_seconds=LOCK_SECONDS))


def model(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "model")
    with _lock:
        if key not in _stages:
            _stages[key] = train_baseline(events(spark, sf))
        return _stages[key]


def scored(spark, sf) -> DataFrame:
    return stage(spark, sf, "scored", lambda: score(events(spark, sf), model(spark, sf)))


def chain_signals(spark, sf) -> DataFrame:
    return stage(spark, sf, "chain_signals", lambda: alerts_from_chains(
        chain_fires_with_text(fires(spark, sf), events(spark, sf), LONG_CHAINS), LONG_CHAINS))


def rule_signals(spark, sf) -> DataFrame:
    return stage(spark, sf, "rule_signals", lambda: alerts_from_matches(events(spark, sf), RULES))


def signals(spark, sf) -> DataFrame:
    """Rule and chain signals (anomaly scores have no SQL counterpart)."""
    return rule_signals(spark, sf).unionByName(chain_signals(spark, sf))


def score_signals(spark, sf) -> DataFrame:
    return alerts_from_scores(scored(spark, sf))


def alerts(spark, sf) -> DataFrame:
    """Merged alerts of rules and chains."""
    return stage(spark, sf, "alerts", lambda: merge_alerts(
        signals(spark, sf), "low", LOCK_SECONDS))


# -- the same in SQL -------------------------------------------------------------------------

def with_parts(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


EV_SQL = """src AS (
  SELECT event_id, user_id AS u, event_type AS ty, ts,
    (CASE WHEN user_id % 3 = 0 THEN '203.' ELSE '10.' END) || (user_id // 250)
      || (CASE WHEN user_id % 3 = 0 THEN '.113.' ELSE '.0.' END) || (user_id % 250) AS src,
    json_extract_string(props, '$.k') AS k, 22 + event_id % 1000 AS port,
    (event_id * 7) % 192 AS pri, 1000 + event_id % 5000 AS pid0,
    CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sshd' WHEN 'purchase' THEN 'sudo'
      WHEN 'click' THEN 'snort' ELSE 'nginx' END AS prog,
    event_id % 5 AS fmt,
    CASE WHEN event_id % 20 = 0
      THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS iso
  FROM events),
msgs AS (
  SELECT *, CASE ty
    WHEN 'error' THEN 'Failed password for user' || u || ' from ' || src || ' port ' || port || ' ssh2'
    WHEN 'signup' THEN 'Accepted password for user' || u || ' from ' || src || ' port ' || port || ' ssh2'
    WHEN 'purchase' THEN 'sudo: user' || u || ' from ' || src || ' : COMMAND=/usr/bin/app as root pid=' || (event_id % 5000 + 1)
    WHEN 'click' THEN 'Port Scan Detected from ' || src
    ELSE src || ' "GET /admin HTTP/1.1" 403' END AS message
  FROM src),
ev AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS event_id, u, ty, fmt, message, k,
    CASE fmt WHEN 0 THEN 'syslog_rfc5424' WHEN 1 THEN 'syslog_rfc3164' WHEN 2 THEN 'cef'
      WHEN 3 THEN 'json' ELSE 'plaintext' END AS log_source,
    CASE WHEN fmt = 1 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(ts) END AS us,
    CASE WHEN event_id % 20 = 0 THEN 330 ELSE 0 END AS tz_offset_min,
    CASE WHEN fmt IN (0, 1) THEN 'web-0' || (u % 7) WHEN fmt = 3 THEN 'app-0' || (u % 7)
      ELSE 'gw-' || (event_id % 3) END AS host,
    CASE WHEN fmt IN (0, 1, 3) THEN prog WHEN fmt = 2 THEN 'FW' END AS program,
    CASE WHEN fmt IN (0, 1, 3) THEN pid0 WHEN ty = 'purchase' THEN event_id % 5000 + 1 END AS pid,
    CASE WHEN fmt IN (0, 1) THEN (['kern','user','mail','daemon','auth','syslog','lpr','news','uucp',
      'cron','authpriv','ftp',NULL,NULL,NULL,NULL,'local0','local1','local2','local3','local4',
      'local5','local6','local7'])[pri // 8 + 1] END AS facility,
    CASE WHEN fmt IN (0, 1) THEN (['emerg','alert','crit','err','warning','notice','info','debug'])
      [pri % 8 + 1] WHEN fmt = 3 THEN (['info','warn','error'])[event_id % 3 + 1] END AS severity,
    src AS source_ip, CASE WHEN fmt = 2 THEN '10.9.0.' || (event_id % 250) END AS dest_ip,
    CASE WHEN fmt = 2 THEN 1024 + event_id % 60000 END AS source_port,
    CASE WHEN fmt = 2 OR ty IN ('error', 'signup') THEN port END AS dest_port,
    CASE WHEN ty IN ('error', 'signup') THEN 'user' || u END AS username,
    CASE WHEN ty = 'purchase' THEN '/usr/bin/app' END AS file_paths,
    CASE WHEN ty = 'view' THEN 'GET' END AS http_method,
    CASE WHEN ty = 'view' THEN '403' END AS http_status,
    concat_ws(',', CASE WHEN fmt IN (0, 1, 3) AND prog IN ('sshd', 'sudo') THEN 'category:auth' END,
      CASE WHEN fmt IN (0, 1, 3) AND prog = 'snort' THEN 'category:network' END,
      CASE WHEN ty = 'error' THEN 'auth:failure' END,
      CASE WHEN ty = 'signup' THEN 'auth:success' END) AS tags,
    CASE fmt
      WHEN 0 THEN '<' || pri || '>1 ' || iso || ' web-0' || (u % 7) || ' ' || prog || ' ' || pid0
        || ' ID47 ' || CASE WHEN event_id % 2 = 0 THEN '[meta k="' || k || '" seq="' || event_id || '"]'
        ELSE '-' END || ' ' || message
      WHEN 1 THEN '<' || pri || '>' || strftime(ts, '%b %d %H:%M:%S') || ' web-0' || (u % 7) || ' '
        || prog || '[' || pid0 || ']: ' || message
      WHEN 2 THEN 'CEF:0|Acme|FW|1.0|' || event_id || '|' || message || '|' || (event_id % 10) || '|src='
        || src || ' spt=' || (1024 + event_id % 60000) || ' dst=10.9.0.' || (event_id % 250) || ' dpt='
        || port || ' act=blocked by policy'
      WHEN 3 THEN '{"timestamp":"' || iso || '","host":"app-0' || (u % 7) || '","process":"' || prog
        || '","pid":' || pid0 || ',"level":"' || (['info','warn','error'])[event_id % 3 + 1]
        || '","user":{"id":' || u || '},"message":"' || replace(message, '"', '\\"') || '"}'
      ELSE message END AS raw
  FROM msgs)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matcher_sql(kind, field, modifier, values) -> str:
    tests = []
    for v in values:
        low = quoted(v.lower())
        if kind == "keyword":
            tests.append(f"contains(lower(message), {low}) OR contains(lower(raw), {low})")
        elif modifier == "re":
            tests.append(f"regexp_matches({field}, {quoted('(?i)' + v)})")
        elif modifier == "exact":
            tests.append(f"lower({field}) = {low}")
        else:
            tests.append(f"contains(lower({field}), {low})")
    return "(" + " OR ".join(tests) + ")"


def rule_sql(rule: dict) -> str:
    """The shipped rules as SQL: their conditions are one group or two joined by ``and``."""
    d = rule["detection"]
    groups = []
    for name in d["condition"].split(" and "):
        body = d[name]
        if isinstance(body, list):
            groups.append(_matcher_sql("keyword", None, None, body))
            continue
        for key, value in body.items():
            field, _, modifier = key.partition("|")
            groups.append(_matcher_sql("field", field, modifier or "exact",
                                       value if isinstance(value, list) else [value]))
    return "(" + " AND ".join(groups) + ")"


def _tags_sql(rule) -> str:
    return ",".join(rule["tags"])


HITS_SQL = "hits AS (" + "\n UNION ALL ".join(
    f"SELECT event_id, us, source_ip AS source_key, message, {i} AS rule_number, "
    f"{quoted(r['id'])} AS rule_id, {quoted(r['title'])} AS title, {quoted(r['level'])} AS level, "
    f"{quoted(','.join(r['tags']))} AS tags, "
    f"{quoted(','.join(sorted(r['detection']['condition'].split(' and '))))} AS groups "
    f"FROM ev WHERE {rule_sql(r)}" for i, r in enumerate(RULES)) + ")"

RANK_SQL = ("(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 "
            "WHEN 'low' THEN 2 WHEN 'informational' THEN 1 ELSE 0 END)")

# steps of the shipped chains as event letters: scan c, failure e, login s, sudo p, web v
CHAIN_PATTERNS = {
    "chain-001": "es", "chain-002": "ce", "chain-003": "sp", "chain-004": "cv",
    "chain-005": "cesp", "chain-006": "eee",
}
CHAINS_SQL = "chains AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(c['id'])}, {quoted(c['title'])}, {quoted(c['severity'])}, "
    f"{c['window_seconds'] * 1000000}, {quoted(c['tactic'])}, {quoted(','.join(c['techniques']))}, "
    f"{quoted('.*'.join(CHAIN_PATTERNS[c['id']]))}, {quoted(CHAIN_PATTERNS[c['id']])}, "
    f"{quoted(','.join(n for n, _ in c['steps']))})"
    for c in LONG_CHAINS) + ") t(chain_id, title, severity, width, tactic, techniques, pattern, "\
    "letters, step_names))"

# the window's events as a string of letters; a chain holds where its pattern is found in it
FIRES_SQL = CHAINS_SQL + f""",
keyed AS (SELECT event_id, us, source_ip AS source_key, message,
  CASE ty WHEN 'error' THEN 'e' WHEN 'signup' THEN 's' WHEN 'purchase' THEN 'p'
    WHEN 'click' THEN 'c' ELSE 'v' END AS letter FROM ev),
windowed AS (SELECT *, list({{'us': us, 'letter': letter, 'id': event_id}}) OVER (
  PARTITION BY source_key ORDER BY us, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS rows_
  FROM keyed),
holding AS (SELECT c.chain_id, w.source_key, w.us, w.event_id,
    list_filter(w.rows_, lambda r: r.us >= w.us - c.width) AS rows_
  FROM windowed w, chains c
  WHERE regexp_matches(list_aggregate(list_transform(list_filter(w.rows_,
    lambda r: r.us >= w.us - c.width), lambda r: r.letter), 'string_agg', ''), c.pattern)),
numbered AS (SELECT chain_id, source_key, us, event_id,
  row_number() OVER (PARTITION BY chain_id, source_key ORDER BY us, event_id) AS n FROM holding),
walk AS (
  SELECT chain_id, source_key, us, event_id, n, us AS last_us, true AS fires FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.chain_id, m.source_key, m.us, m.event_id, m.n,
    CASE WHEN m.us - w.last_us >= {LOCK_SECONDS * 1000000} THEN m.us ELSE w.last_us END,
    m.us - w.last_us >= {LOCK_SECONDS * 1000000}
  FROM walk w JOIN numbered m ON m.chain_id = w.chain_id AND m.source_key = w.source_key
    AND m.n = w.n + 1),
fires AS (SELECT chain_id, source_key, us, event_id, rows_[1].us AS first_us, rows_
  FROM walk JOIN holding USING (chain_id, source_key, us, event_id) WHERE walk.fires)"""

# greedy evidence: the first event of a step's letter after the one taken before
STEPS_SQL = """taken AS (
  SELECT f.chain_id, f.source_key, f.us, f.event_id, f.first_us, f.rows_, c.letters, c.step_names, 0 AS n,
    0::BIGINT AS pos, NULL::VARCHAR AS step_event FROM fires f JOIN chains c USING (chain_id)
  UNION ALL
  SELECT chain_id, source_key, us, event_id, first_us, rows_, letters, step_names, n + 1, nxt, rows_[nxt].id
  FROM (SELECT *, pos + list_position(list_transform(rows_[pos + 1:], lambda r: r.letter), letters[n + 1]) AS nxt
    FROM taken WHERE n < length(letters)))"""

SIGNALS_SQL = STEPS_SQL + """,
last_step AS (SELECT t.chain_id, t.source_key, t.us, t.event_id AS trigger_id, t.first_us, t.step_event
  FROM taken t WHERE n = length(letters)),
signals AS (
  SELECT 'sigma' AS alert_type, h.title, level AS severity, source_key, event_id, message[1:256] AS event_message,
    us, h.rule_id AS sigma_rule_id, '' AS chain_id, CAST(0 AS DOUBLE) AS duration_seconds, '' AS mitre_tactic,
    list_aggregate(list_transform(list_filter(string_split(tags, ','), lambda t: t LIKE 'attack.t%'),
      lambda t: upper(replace(t, 'attack.', ''))), 'string_agg', ',') AS techniques,
    sha256('sigma:' || source_key || ':' || h.title)[1:16] AS fingerprint, 1 AS kind FROM hits h
  UNION ALL
  SELECT 'correlation', c.title, c.severity, l.source_key, l.step_event, k.message[1:256], l.us, '', l.chain_id,
    CAST(l.us - l.first_us AS DOUBLE) / 1000000, c.tactic, c.techniques,
    sha256('correlation:' || l.source_key || ':' || l.chain_id)[1:16], 2
  FROM last_step l JOIN chains c USING (chain_id) JOIN keyed k ON k.event_id = l.step_event)"""

ALERTS_SQL = SIGNALS_SQL + f""",
marked AS (SELECT *, CASE WHEN us - lag(us) OVER p < {LOCK_SECONDS * 1000000} THEN 0 ELSE 1 END AS opens
  FROM signals WHERE {RANK_SQL} >= 2 WINDOW p AS (PARTITION BY fingerprint ORDER BY us, event_id, kind, title)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY fingerprint ORDER BY us, event_id, kind, title
  ROWS UNBOUNDED PRECEDING) AS island FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, island ORDER BY us, event_id, kind, title) AS rn,
  count(*) OVER (PARTITION BY fingerprint, island) AS hit_count,
  min(us) OVER (PARTITION BY fingerprint, island) AS first_us,
  max(us) OVER (PARTITION BY fingerprint, island) AS last_us FROM islands),
digests AS (SELECT *, sha256(fingerprint || '|' || event_id || ':' || us) AS digest FROM ranked WHERE rn = 1),
alerts AS (SELECT *, digest[1:8] || '-' || digest[9:12] || '-' || digest[13:16] || '-' || digest[17:20] || '-'
  || digest[21:32] AS alert_id FROM digests)"""


# from user 64,000 on the second octet is above 255: the parser finds no address in such a message, and
# the event goes by its host; only the src field of a CEF line is taken as it stands
VALID_SQL = "CAST(string_split({ip}, '.')[2] AS INT) < 256"
WIDE = [
    ("src AS source_ip, CASE", "CASE WHEN fmt = 2 OR u < 64000 THEN src END AS source_ip, CASE"),
    ("source_ip AS source_key", "coalesce(source_ip, host) AS source_key"),
    ("CAST(string_split(source_ip, '.')[1] AS INT) / 255", "coalesce(CAST(string_split(source_ip, '.')[1] AS INT), 0) / 255"),
    ("'ip:' || source_key", f"CASE WHEN coalesce({VALID_SQL.format(ip='source_key')}, false) THEN 'ip:' ELSE 'host:' END || source_key"),
    # the walk from fire to fire instead of row to row: a host has many rows
    ("AS n FROM holding)", f"""AS n, min(us) OVER (PARTITION BY chain_id, source_key ORDER BY us
    RANGE BETWEEN {LOCK_SECONDS * 1000000} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM holding),
firsts AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY chain_id, source_key, us ORDER BY n) = 1)"""),
    (f"""us AS last_us, true AS fires FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.chain_id, m.source_key, m.us, m.event_id, m.n,
    CASE WHEN m.us - w.last_us >= {LOCK_SECONDS * 1000000} THEN m.us ELSE w.last_us END,
    m.us - w.last_us >= {LOCK_SECONDS * 1000000}
  FROM walk w JOIN numbered m ON m.chain_id = w.chain_id AND m.source_key = w.source_key
    AND m.n = w.n + 1)""", """next_us, true AS fires FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.chain_id, m.source_key, m.us, m.event_id, m.n, m.next_us, true
  FROM walk w JOIN firsts m ON m.chain_id = w.chain_id AND m.source_key = w.source_key AND m.us = w.next_us)"""),
]


def wide(sql: str) -> str:
    """The SQL for users of any number."""
    for old, new in WIDE:
        sql = sql.replace(old, new)
    return sql


def ev(body: str) -> str:
    return with_parts(EV_SQL) + body


def hits(body: str) -> str:
    return with_parts(EV_SQL, HITS_SQL) + body


def fired(body: str) -> str:
    return with_parts(EV_SQL, FIRES_SQL) + body


def stepped(body: str) -> str:
    return with_parts(EV_SQL, FIRES_SQL, STEPS_SQL) + body


def signalled(body: str) -> str:
    return with_parts(EV_SQL, HITS_SQL, FIRES_SQL, SIGNALS_SQL) + body


def alerted(body: str) -> str:
    return with_parts(EV_SQL, HITS_SQL, FIRES_SQL, ALERTS_SQL) + body
