"""Alerts as STIX 2.1 objects."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog.functions.hashing import stix_id
from vigilog.functions.severity import stix_confidence
from vigilog.functions.text import non_empty
from vigilog.values import TECHNIQUE_URL


def stix_time(us: Column) -> Column:
    """Whole seconds, as the bundles carry them."""
    return F.concat(
        F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def stix_pattern(alert_type: Column, source_key: Column) -> Column:
    quoted = F.concat(F.lit("'"), source_key, F.lit("'"))
    by_source = F.concat(F.lit("[network-traffic:src_ref.value = "), quoted, F.lit("]"))
    is_address = source_key.rlike(r"^\d+\.\d+")
    return (
        F.when(alert_type == "sigma", F.when(is_address, by_source).otherwise(F.concat(
            F.lit("[network-traffic:dst_ref.type = 'ipv4-addr' AND process:name = "), quoted,
            F.lit("]"))))
        .when(alert_type == "correlation", F.concat(
            F.lit("[network-traffic:src_ref.value = "), quoted,
            F.lit(" AND network-traffic:dst_port > 0]")))
        .otherwise(F.when(is_address, by_source).otherwise(F.lit("[process:name != 'unknown']")))
    )


def technique_references(techniques: Column) -> Column:
    return F.transform(
        F.filter(techniques, lambda t: F.startswith(F.upper(t), F.lit("T"))),
        lambda t: F.struct(
            F.lit("mitre-attack").alias("source_name"), F.upper(t).alias("external_id"),
            F.concat(F.lit(TECHNIQUE_URL), F.replace(F.upper(t), F.lit("."), F.lit("")),
                     F.lit("/")).alias("url")))


def base64_text(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def bundle(created: Column) -> Column:
    """JSON of one alert's bundle: indicator, sighting and observed data."""
    c = F.col
    seen = stix_time(c("us"))
    created_text = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    indicator_id = stix_id("indicator", c("alert_id"))

    def head(kind, identifier):
        return [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"),
                identifier.alias("id"), created_text.alias("created"),
                created_text.alias("modified")]

    indicator = F.struct(
        *head("indicator", indicator_id), c("title").alias("name"),
        F.coalesce(non_empty(c("description")), c("title")).alias("description"),
        stix_pattern(c("alert_type"), c("source_key")).alias("pattern"),
        F.lit("stix").alias("pattern_type"), seen.alias("valid_from"),
        stix_confidence(c("severity")).alias("confidence"),
        F.array_union(F.array("alert_type", "severity"), c("sigma_tags")).alias("labels"),
        technique_references(c("mitre_techniques")).alias("external_references"))
    sighting = F.struct(
        *head("sighting", stix_id("sighting", F.concat(c("alert_id"), F.lit(":sight")))),
        indicator_id.alias("sighting_of_ref"), stix_time(c("first_us")).alias("first_seen"),
        stix_time(c("last_us")).alias("last_seen"), c("hit_count").alias("count"),
        F.lit(False).alias("summary"),
        F.concat(F.lit("Alert fired "), c("hit_count"), F.lit(" time(s). Source: "),
                 c("source_key"), F.lit(". Triggering message: "),
                 F.substring("event_message", 1, 200)).alias("description"))
    observed = F.struct(
        *head("observed-data", stix_id("observed-data", F.coalesce(
            non_empty(c("event_id")), c("alert_id")))),
        seen.alias("first_observed"), seen.alias("last_observed"),
        c("hit_count").alias("number_observed"),
        F.array().cast("array<string>").alias("object_refs"),
        F.struct(
            c("alert_id").alias("x_vigilog_alert_id"), c("alert_type").alias("x_vigilog_alert_type"),
            c("event_id").alias("x_vigilog_event_id"),
            F.substring("event_message", 1, 500).alias("x_vigilog_event_message"),
            c("severity").alias("x_vigilog_severity"),
            non_empty(c("chain_id")).alias("x_vigilog_chain_id"),
            F.nullif(c("anomaly_score"), F.lit(0.0)).alias("x_vigilog_anomaly_score"),
            F.transform(F.slice("xai_features", 1, 5), lambda x: F.struct(
                x["feature"].alias("feature"), F.bround(x["deviation"], 4).alias("deviation")))
            .alias("x_vigilog_xai_features"),
            non_empty(c("mitre_tactic")).alias("x_vigilog_mitre_tactic"),
            F.when(F.size("chain_steps") > 0, c("chain_steps")).alias("x_vigilog_chain_steps"),
        ).alias("custom_properties"))
    objects = F.concat_ws(",", F.to_json(indicator), F.to_json(sighting), F.to_json(observed))
    return F.concat(
        F.lit('{"type":"bundle","id":"'), stix_id("bundle", c("alert_id")),
        F.lit('","spec_version":"2.1","objects":['), objects, F.lit("]}"))
