"""Alerts from the three kinds of signals, merged and ranked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.hashing import alert_id, fingerprint
from vigilog.functions.severity import ml_severity, severity_rank
from vigilog.functions.text import non_empty
from vigilog.operators.dedup import dedup_gap
from vigilog.operators.rules import apply_rules
from vigilog.sources.catalog import CHAINS
from vigilog.values import DEDUP_SECONDS, SEVERITY_RANK

STEPS = "array<struct<step:string,event_id:string,message:string>>"
EXPLANATION = "array<struct<feature:string,deviation:double>>"

# alert columns in order: name -> (type, value where an alert kind has none)
ALERT_COLUMNS = {
    "alert_type": ("string", ""), "title": ("string", ""), "description": ("string", ""),
    "severity": ("string", "medium"), "source_key": ("string", ""), "event_id": ("string", ""),
    "event_message": ("string", ""), "us": ("bigint", None), "sigma_rule_id": ("string", ""),
    "sigma_tags": ("array<string>", ()), "chain_id": ("string", ""), "chain_steps": (STEPS, ()),
    "duration_seconds": ("double", 0.0), "mitre_tactic": ("string", ""),
    "mitre_techniques": ("array<string>", ()), "anomaly_score": ("double", 0.0),
    "xai_features": (EXPLANATION, ()), "fingerprint": ("string", ""),
}
TYPE_ORDER = {"sigma": 1, "correlation": 2, "ml": 3}


def _alert_rows(df: DataFrame, **values: Column) -> DataFrame:
    columns = []
    for name, (kind, default) in ALERT_COLUMNS.items():
        empty = F.array() if default == () else F.lit(default)
        columns.append(values.get(name, empty).cast(kind).alias(name))
    return df.select(*columns)


def alert_source() -> Column:
    return F.coalesce(non_empty(F.col("source_ip")), F.col("host"))


def technique_ids(tags: Column) -> Column:
    """Technique ids of the tags: ``attack.t1110.001`` to ``T1110.001``."""
    return F.transform(
        F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit("attack.t"))),
        lambda t: F.upper(F.substring_index(t, "attack.", -1)),
    )


def alerts_from_matches(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One alert per event and fired rule."""
    hits = apply_rules(events.withColumn("_source", alert_source()), rules,
                       keep=("event_id", "_source", "message", "timestamp"))
    return _alert_rows(
        hits, alert_type=F.lit("sigma"), title=F.col("title"), description=F.col("description"),
        severity=F.col("level"), source_key=F.col("_source"), event_id=F.col("event_id"),
        event_message=F.substring("message", 1, 256), us=F.unix_micros("timestamp"),
        sigma_rule_id=F.col("rule_id"), sigma_tags=F.col("rule_tags"),
        mitre_techniques=technique_ids(F.col("rule_tags")),
        fingerprint=fingerprint(F.lit("sigma"), F.col("_source"), F.col("title")),
    )


def chain_fires_with_text(fires: DataFrame, events: DataFrame, chains=CHAINS) -> DataFrame:
    """Names and messages for the step rows of fired chains (source_key, us, event_id, steps)."""
    names = F.create_map(*[x for c in chains for x in (
        F.lit(c["id"]), F.array(*[F.lit(n) for n, _ in c["steps"]]))])
    flat = fires.select(
        "chain_id", "source_key", "us", F.col("event_id").alias("trigger_id"), "first_us",
        F.posexplode("steps").alias("n", "at"))
    flat = flat.select("*", F.col("at.event_id").alias("event_id"),
                       F.get(F.element_at(names, F.col("chain_id")), F.col("n")).alias("step"))
    texts = events.select("event_id", F.col("message").alias("_message"))
    rows = flat.join(texts, "event_id", "left")
    return rows.groupBy("chain_id", "source_key", "us", "trigger_id", "first_us").agg(
        F.array_sort(F.collect_list(F.struct("n", "step", "event_id", "_message"))).alias("steps"))


def alerts_from_chains(fires: DataFrame, chains=CHAINS) -> DataFrame:
    """One alert per fired chain; its event is the last step's."""
    facts = F.create_map(*[x for c in chains for x in (F.lit(c["id"]), F.struct(
        F.lit(c["title"]).alias("title"), F.lit(c["severity"]).alias("severity"),
        F.lit(c["tactic"]).alias("tactic"),
        F.array(*[F.lit(t) for t in c["techniques"]]).alias("techniques")))])
    rows = fires.withColumn("_chain", F.element_at(facts, F.col("chain_id")))
    last = F.element_at("steps", -1)
    return _alert_rows(
        rows, alert_type=F.lit("correlation"), title=F.col("_chain.title"),
        description=F.col("_chain.title"), severity=F.col("_chain.severity"),
        source_key=F.col("source_key"), event_id=last["event_id"],
        event_message=F.substring(last["_message"], 1, 256), us=F.col("us"),
        chain_id=F.col("chain_id"),
        chain_steps=F.transform("steps", lambda s: F.struct(
            s["step"].alias("step"), s["event_id"].alias("event_id"),
            F.substring(s["_message"], 1, 120).alias("message"))),
        duration_seconds=(F.col("us") - F.col("first_us")) / 1_000_000,
        mitre_tactic=F.col("_chain.tactic"), mitre_techniques=F.col("_chain.techniques"),
        fingerprint=fingerprint(F.lit("correlation"), F.col("source_key"), F.col("chain_id")),
    )


def alerts_from_scores(scored: DataFrame) -> DataFrame:
    """One alert per anomalous event; scores within a tenth share a fingerprint."""
    score = F.col("anomaly_score")
    bucket = F.concat(F.lit("ml:"), F.floor(score * 10).cast("string"))
    source = alert_source()
    drivers = F.array_join(F.transform(
        F.slice("top_features", 1, 3),
        lambda t: F.concat(t["feature"], F.lit("="), F.format_string("%.2f", t["deviation"]))),
        ", ")
    return _alert_rows(
        scored.where("is_anomalous"), alert_type=F.lit("ml"),
        title=F.format_string("ML Anomaly Detected (score=%.3f)", score),
        description=F.concat(F.lit("Anomalous event. Top drivers: "), drivers),
        severity=ml_severity(score), source_key=source, event_id=F.col("event_id"),
        event_message=F.substring("message", 1, 256), us=F.unix_micros("timestamp"),
        anomaly_score=score, xai_features=F.col("top_features"),
        fingerprint=fingerprint(F.lit("ml"), source, bucket),
    )


def severity_at_least(alerts: DataFrame, minimum: str = "low") -> DataFrame:
    """Alerts of the minimum severity or more; an unknown minimum keeps rank 1 and up."""
    return alerts.where(severity_rank("severity") >= SEVERITY_RANK.get(minimum, 1))


def merge_alerts(signals: DataFrame, minimum: str = "low", seconds: int = DEDUP_SECONDS
                 ) -> DataFrame:
    """Severity filter, then repeated hits of a fingerprint merged into their first alert."""
    rows = severity_at_least(signals, minimum).withColumn(
        "_kind", F.element_at(F.create_map(*[F.lit(x) for p in TYPE_ORDER.items() for x in p]),
                              F.col("alert_type")))
    merged = dedup_gap(rows, ["fingerprint"], "us", seconds, ["event_id", "_kind", "title"])
    return merged.drop("_kind").withColumn(
        "alert_id", alert_id(F.col("fingerprint"), F.concat_ws(":", "event_id", "us")))


def alerts(events: DataFrame, rules: list[dict], fires: DataFrame | None = None,
           scored: DataFrame | None = None, chains=CHAINS, minimum: str = "low",
           seconds: int = DEDUP_SECONDS) -> DataFrame:
    """All signals of a batch in one merged alert table."""
    signals = alerts_from_matches(events, rules)
    if fires is not None:
        signals = signals.unionByName(
            alerts_from_chains(chain_fires_with_text(fires, events, chains), chains))
    if scored is not None:
        signals = signals.unionByName(alerts_from_scores(scored))
    return merge_alerts(signals, minimum, seconds)


def first_alert_of_event(alert_rows: DataFrame) -> DataFrame:
    """(event_id, alert_id) of each event's first alert: rules, then chains, then scores."""
    order = F.element_at(F.create_map(*[F.lit(x) for p in TYPE_ORDER.items() for x in p]),
                         F.col("alert_type"))
    return alert_rows.groupBy("event_id").agg(
        F.min_by("alert_id", F.struct(order, "title", "alert_id")).alias("alert_id"))


def with_alert_id(events: DataFrame, alert_rows: DataFrame) -> DataFrame:
    return events.drop("alert_id").join(first_alert_of_event(alert_rows), "event_id", "left")


def with_chain_tags(events: DataFrame, fires: DataFrame, chains=CHAINS) -> DataFrame:
    """Tags of the chains an event fired."""
    severities = F.create_map(*[F.lit(x) for c in chains for x in (c["id"], c["severity"])])
    # an event fires a chain at most once, so the list is as long as the chains are many
    tags = fires.groupBy("event_id").agg(F.array_sort(F.collect_set("chain_id")).alias("_c"))
    return (
        events.join(tags, "event_id", "left")
        .withColumn("tags", F.array_union("tags", F.flatten(F.transform(
            F.coalesce("_c", F.array().cast("array<string>")),
            lambda c: F.array(F.concat(F.lit("correlated:"), c),
                              F.concat(F.lit("chain_severity:"), F.element_at(severities, c)))))))
        .drop("_c")
    )


# -- selections ------------------------------------------------------------------------------

def filter_alerts(alert_rows: DataFrame, severity: str | None = None,
                  alert_type: str | None = None) -> DataFrame:
    if severity:
        alert_rows = alert_rows.where(F.col("severity") == severity)
    if alert_type:
        alert_rows = alert_rows.where(F.col("alert_type") == alert_type)
    return alert_rows


def select_alerts(alert_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Alerts named by ``wanted(id)``: an id prefix, an id beginning with the alert's first
    eight digits, or a fingerprint.

    All three are equalities: each alert has its prefixes, its first eight digits and its
    fingerprint as keys, each request the keys it may be meant by.
    """
    key = lambda kind, value: F.concat(F.lit(kind), value)
    first = F.substring("alert_id", 1, 8)
    prefixes = F.transform(F.sequence(F.lit(0), F.length("alert_id")),
                           lambda n: key("p", F.substring(F.col("alert_id"), F.lit(1), n)))
    named = alert_rows.select("alert_id", F.explode(F.concat(
        prefixes, F.array(key("h", first), key("f", F.col("fingerprint"))))).alias("_key"))
    asked = wanted.select(F.explode(F.array_compact(F.array(
        key("p", F.col("id")), key("f", F.col("id")),
        F.when(F.length("id") >= 8, key("h", F.substring("id", 1, 8)))))).alias("_key")).distinct()
    chosen = named.join(asked, "_key", "left_semi").select("alert_id").distinct()
    return alert_rows.join(chosen, "alert_id", "left_semi")


def recent_alerts(alert_rows: DataFrame, limit: int = 50, offset: int = 0,
                  severity: str | None = None, alert_type: str | None = None) -> DataFrame:
    """A page of the newest alerts."""
    rows = filter_alerts(alert_rows, severity, alert_type)
    return rows.orderBy(F.desc("us"), "alert_id").offset(offset).limit(limit)


def by_severity(alert_rows: DataFrame) -> DataFrame:
    """Most severe first, newest first within a severity."""
    return alert_rows.orderBy(F.desc(severity_rank("severity")), F.desc("us"), "alert_id")
