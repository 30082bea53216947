"""Counts and summaries over events and alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.functions.severity import severity_rank
from vigilog.values import SEVERITY_RANK, WINDOW_CAP


def pipeline_stats(events: DataFrame, signals: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: events, rule hits, chain alerts, anomalies, alerts written and merged away."""
    one = F.lit(1).alias("_one")
    of = lambda kind: F.count_if(F.col("alert_type") == kind)
    a = events.agg(F.count(F.lit(1)).alias("events_processed")).select("*", one)
    b = signals.agg(of("sigma").alias("sigma_hits"), of("correlation").alias("chain_alerts"),
                    of("ml").alias("ml_anomalies")).select("*", one)
    c = merged.agg(
        F.count(F.lit(1)).alias("alerts_written"),
        F.coalesce(F.sum(F.col("hit_count") - 1), F.lit(0)).alias("deduped")).select("*", one)
    return a.join(b, "_one").join(c, "_one").drop("_one")


def events_per_second(events: DataFrame, us: Column, seconds: int = 2) -> DataFrame:
    """Rate per tick of two seconds, ticks without events left out."""
    tick = (F.floor(us / F.lit(seconds * 1_000_000)) * seconds).alias("tick")
    return events.groupBy(tick).agg(F.round(F.count(F.lit(1)) / seconds, 1).alias("events_per_sec"))


def alert_stats(signals: DataFrame, merged: DataFrame, minimum: str = "low") -> DataFrame:
    """Per alert type: new alerts, hits merged away, hits suppressed by severity.

    Suppressed anomaly signals are not counted, as no rule or chain produced them.
    """
    low = severity_rank("severity") < SEVERITY_RANK.get(minimum, 1)
    suppressed = signals.groupBy("alert_type").agg(
        F.count_if(low & (F.col("alert_type") != "ml")).alias("suppressed"))
    written = merged.groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum(F.col("hit_count") - 1).alias("deduped"))
    return suppressed.join(written, "alert_type", "left").select(
        "alert_type", F.coalesce("alerts", F.lit(0)).alias("alerts"),
        F.coalesce("deduped", F.lit(0)).alias("deduped"), "suppressed")


def window_load(events: DataFrame, key: str, us: str, seconds: int, cap: int = WINDOW_CAP
                ) -> DataFrame:
    """Sources and events inside the window that ends at the newest event."""
    newest = events.agg(F.max(us)).scalar()
    recent = events.where(F.col(us) >= newest - seconds * 1_000_000)
    return recent.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n")).agg(
        F.count(F.lit(1)).alias("tracked_sources"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("buffered_events"))


def executive_counts(alerts: DataFrame) -> DataFrame:
    source = F.when(F.col("source_key") != "", F.col("source_key"))
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_distinct(source).alias("unique_sources"),
        F.count_distinct("alert_type").alias("alert_types"))


def most_severe(alerts: DataFrame, n: int = 5) -> DataFrame:
    return alerts.orderBy(F.desc(severity_rank("severity")), "us", "alert_id").limit(n)


def cluster_summary(alerts: DataFrame) -> DataFrame:
    """One row about a set of alerts; sources are counted, not listed."""
    return alerts.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.array_join(F.array_sort(F.collect_set("alert_type")), ", ").alias("alert_types"),
        F.array_join(F.array_sort(F.collect_set("severity")), ", ").alias("severities"),
        F.count_distinct(F.when(F.col("source_key") != "", F.col("source_key"))).alias("sources"))


def source_map(alerts: DataFrame, places: DataFrame) -> DataFrame:
    """Alert count, worst severity and place of each public, located source address."""
    rank = F.when(severity_rank("severity") > 1, severity_rank("severity")).otherwise(0)
    counts = alerts.where(F.col("source_key").rlike(r"^\d+\.\d+\.\d+\.\d+$")).groupBy(
        F.col("source_key").alias("ip")).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.max_by("severity", rank).alias("_word"), F.max(rank).alias("_rank"))
    located = places.where(
        ~F.col("is_private") & (F.coalesce("latitude", F.lit(0)) != 0)
        & (F.coalesce("longitude", F.lit(0)) != 0)).select("ip", "latitude", "longitude")
    return counts.join(located, "ip").select(
        "ip", "alerts", F.when(F.col("_rank") > 2, F.col("_word")).otherwise("low")
        .alias("top_severity"), "latitude", "longitude")


def replay(alerts: DataFrame) -> DataFrame:
    """The steps of chain alerts on an even time line that ends at the alert."""
    rows = alerts.where((F.col("alert_type") == "correlation") & (F.size("chain_steps") > 0))
    steps = rows.select(
        "alert_id", "chain_id", "title", "severity", "source_key", "us", "duration_seconds",
        F.size("chain_steps").alias("step_count"),
        F.posexplode("chain_steps").alias("index", "_s"))
    length = F.col("duration_seconds") * 1_000_000
    when = F.when(
        (F.col("duration_seconds") != 0) & (F.col("step_count") > 1),
        F.col("us") - length + length * F.col("index") / (F.col("step_count") - 1),
    ).otherwise(F.col("us"))
    return steps.select(
        "alert_id", "chain_id", "title", "severity", "source_key", "step_count", "index",
        F.col("_s.step").alias("step_name"), F.col("_s.message").alias("message"),
        F.round(when).cast("bigint").alias("step_us"))


def threat_timeline(alerts: DataFrame, n: int = 15, spacing: int = 30) -> DataFrame:
    """The first alerts in time order with their label on the story's clock."""
    first = alerts.orderBy("us", "alert_id").limit(n)
    number = F.row_number().over(Window.orderBy("us", "alert_id")) - 1
    return first.select(
        number.cast("bigint").alias("position"),
        F.concat(F.lit("T+"), number * spacing, F.lit("s")).alias("label"),
        F.upper("alert_type").alias("alert_type"), "title", "source_key", "us")


def techniques_seen(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.explode("mitre_techniques").alias("technique")).distinct()
