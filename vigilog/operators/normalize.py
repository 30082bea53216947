"""Parsed lines to the common event schema."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import (
    all_matches, entry, first_match, hold, last_wins_map, non_empty, strip, whole_number,
)
from vigilog.values import (
    AUTH_PROGRAMS, DEST_IP_KEYS, DEST_PORT_KEYS, NETWORK_PROGRAMS, RE_AUTH_FAILURE,
    RE_AUTH_SUCCESS, RE_HTTP_METHOD, RE_HTTP_STATUS, RE_IPV4, RE_PATH, RE_PID, RE_PORT, RE_USER,
    SOURCE_IP_KEYS, SOURCE_PORT_KEYS,
)

EVENT_COLUMNS = [
    "event_id", "timestamp", "tz_offset_min", "ingested_at", "host", "source_ip", "dest_ip",
    "source_port", "dest_port", "log_source", "facility", "severity", "program", "pid",
    "message", "raw", "fields", "tags", "sigma_matches", "anomaly_score", "alert_id",
]


def extract_ips(message: Column) -> Column:
    return all_matches(message, RE_IPV4)


def extract_port(message: Column) -> Column:
    return whole_number(F.regexp_extract(message, RE_PORT, 1))


def user_name(found: Column) -> Column:
    """What follows a user word, unless it is a filler word or very long."""
    return F.when((found != "") & (F.length(found) < 64) & ~found.isin("from", "by", "for"), found)


def extract_user(message: Column) -> Column:
    return user_name(F.regexp_extract(message, RE_USER, 1))


def extract_pid(message: Column) -> Column:
    return whole_number(F.regexp_extract(message, RE_PID, 1), "bigint")


def extract_paths(message: Column) -> Column:
    return F.slice(all_matches(message, RE_PATH, 0), 1, 5)


def extract_http_method(message: Column) -> Column:
    return first_match(message, RE_HTTP_METHOD)


def extract_http_status(message: Column) -> Column:
    return whole_number(F.regexp_extract(message, RE_HTTP_STATUS, 1))


def event_tags(program: Column, failed: Column, succeeded: Column) -> Column:
    """Category tags of the program, outcome tags of the message."""
    return F.array_compact(F.array(
        F.when(program.isin(AUTH_PROGRAMS), "category:auth"),
        F.when(program.isin(NETWORK_PROGRAMS), "category:network"),
        F.when(failed, "auth:failure"), F.when(succeeded, "auth:success"),
    ))


def _alias_text(keys: list[str]) -> Column:
    """First alias that holds something; a JSON 0, false or empty list holds nothing."""
    is_json = F.col("log_source") == "json"
    values = []
    for key in keys:
        value = F.try_element_at(F.col("fields"), F.lit(key))
        values.append(
            F.when((value != "") & ~(is_json & value.isin("0", "false", "[]", "{}")), value)
        )
    return F.coalesce(*values)


def _alias_int(keys: list[str]) -> Column:
    """As text, but a JSON number such as 22.7 is truncated where the text "22.7" is no number."""
    text = _alias_text(keys)
    numbers = F.coalesce(*[
        F.when(
            F.schema_of_variant(F.try_variant_get("_json", f"$['{k}']", "variant"))
            .rlike("^(DOUBLE|DECIMAL|FLOAT)"),
            F.try_variant_get("_json", f"$['{k}']", "double").try_cast("int"),
        ) for k in keys
    ])
    return F.coalesce(whole_number(text), F.when(text.isNotNull(), numbers))


def host_fallback(host: Column, source_host: Column) -> Column:
    """The sender stands in for an unknown host."""
    return F.when(host == "unknown", F.coalesce(source_host, host)).otherwise(host)


def get_field(df: DataFrame, path: str) -> Column:
    """Text of a rule's field path: an event column, else a key of ``fields``."""
    types = dict(df.dtypes)
    if path in types and not path.startswith("_"):
        if types[path].startswith("array<string>"):
            return F.array_join(F.col(path), " ")
        if types[path].startswith(("map", "struct", "array")):
            return F.to_json(F.col(path))
        return F.col(path).cast("string")
    key = path[len("fields."):] if path.startswith("fields.") else path
    return F.try_element_at(F.col("fields"), F.lit(key))


def normalize(parsed: DataFrame) -> DataFrame:
    """Parsed rows to events: aliases, values read out of the message, tags."""
    if "_json" not in parsed.columns:
        parsed = parsed.withColumn("_json", F.lit(None).cast("variant"))
    extra = [
        c for c in parsed.columns if c not in EVENT_COLUMNS and c not in ("_json", "source_host")
    ]
    sender = F.col("source_host") if "source_host" in parsed.columns else F.lit(None)
    message = F.col("message")
    # each pattern runs once here; what is made of the findings comes after
    staged = parsed.select(
        *extra, "event_id", "timestamp", "tz_offset_min", "ingested_at", "log_source",
        "facility", "severity", "program", "message", "raw", "fields",
        host_fallback(F.col("host"), sender).alias("host"),
        F.col("pid").alias("_pid"),
        _alias_text(SOURCE_IP_KEYS).alias("_src"),
        _alias_text(DEST_IP_KEYS).alias("_dst"),
        _alias_int(SOURCE_PORT_KEYS).alias("source_port"),
        _alias_int(DEST_PORT_KEYS).alias("_dport"),
        extract_ips(message).alias("_ips"),
        F.array_join(extract_paths(message), " ").alias("_paths"),
        F.regexp_extract(message, RE_PORT, 1).alias("_port_said"),
        F.regexp_extract(message, RE_PID, 1).alias("_pid_said"),
        F.regexp_extract(message, RE_USER, 1).alias("_user"),
        F.regexp_extract(message, RE_HTTP_METHOD, 1).alias("_method"),
        F.regexp_extract(message, RE_HTTP_STATUS, 1).alias("_status"),
        message.rlike(RE_AUTH_FAILURE).alias("_failed"),
        message.rlike(RE_AUTH_SUCCESS).alias("_succeeded"),
        F.lower("program").alias("_program"),
    )
    passed = [*extra, "event_id", "timestamp", "tz_offset_min", "ingested_at", "host",
              "log_source", "facility", "severity", "program", "message", "raw"]
    staged = staged.select(
        *passed, "fields", "source_port", "_pid", "_dport", "_program", "_failed",
        "_succeeded", "_paths", "_method",
        whole_number(F.col("_port_said")).alias("_port_said"),
        whole_number(F.col("_pid_said"), "bigint").alias("_pid_said"),
        whole_number(F.col("_status")).alias("_status"),
        non_empty(strip(F.col("_src"))).alias("_src"),
        non_empty(strip(F.col("_dst"))).alias("_dst"),
        F.try_element_at("_ips", F.lit(1)).alias("_first_ip"),
        F.try_element_at("_ips", F.lit(2)).alias("_second_ip"),
        user_name(F.col("_user")).alias("_user"),
    )
    read_out = {
        "extracted_src_ip": F.when(F.col("_src").isNull(), F.col("_first_ip")),
        "extracted_dst_ip": F.when(F.col("_dst").isNull(), F.col("_second_ip")),
        "username": F.col("_user"), "file_paths": non_empty(F.col("_paths")),
        "http_method": non_empty(F.col("_method")), "http_status": F.col("_status"),
    }
    found = F.array_compact(F.array(*[
        F.when(value.isNotNull(), entry(name, value)) for name, value in read_out.items()]))
    # what the line states wins over what is read out of its message
    staged = staged.withColumn("_entries", F.concat(found, F.map_entries("fields")))
    return hold(staged.select(
        *passed,
        F.coalesce("_src", "_first_ip").alias("source_ip"),
        F.coalesce("_dst", "_second_ip").alias("dest_ip"),
        "source_port",
        F.coalesce(F.nullif("_dport", F.lit(0)), "_port_said", "_dport").alias("dest_port"),
        F.coalesce(F.nullif("_pid", F.lit(0)), "_pid_said", "_pid").alias("pid"),
        last_wins_map("_entries").alias("fields"),
        event_tags(F.col("_program"), F.col("_failed"), F.col("_succeeded")).alias("tags"),
        F.array().cast("array<string>").alias("sigma_matches"),
        F.lit(None).cast("double").alias("anomaly_score"),
        F.lit(None).cast("string").alias("alert_id"),
    ), [*passed, "sigma_matches", "anomaly_score", "alert_id"]).select(*extra, *EVENT_COLUMNS)


def source_key(source_ip="source_ip", host="host") -> Column:
    """Key of the per-source work: the source address, else the host."""
    return F.coalesce(non_empty(F.col(source_ip)), non_empty(F.col(host)), F.lit("unknown"))
