"""Raw log lines to fields: format detection and the five formats."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import (
    all_matches, captured, entry, hold, last_wins_map, lookup, pairs, strip, whole_number,
)
from vigilog.values import (
    FACILITIES, JSON_HOST_KEYS, JSON_MESSAGE_KEYS, JSON_PROGRAM_KEYS, JSON_TIME_KEYS, MONTHS,
    RE_CEF, RE_CEF_EXTENSION, RE_ISO_TIME, RE_RFC3164, RE_RFC5424, RE_SD_PARAM, SEVERITIES,
)

NO_FIELDS = "array<struct<key:string,value:string>>"


def decode_pri(pri: Column) -> tuple[Column, Column]:
    """Syslog PRI to (facility, severity); unknown codes are null."""
    number = whole_number(pri)
    return (
        lookup(FACILITIES, F.shiftright(number, 3)),
        lookup(SEVERITIES, number.bitwiseAND(F.lit(7))),
    )


def iso_text(text: Column) -> Column:
    """ISO 8601 text in the form a cast reads: decimal point, offset with a colon."""
    pointed = F.when(F.contains(text, F.lit(",")), F.replace(text, F.lit(","), F.lit("."))
                     ).otherwise(text)
    return F.when(
        (F.length(text) > 10) & F.substring(text, -5, 1).isin("+", "-"),
        F.concat(F.substring(pointed, F.lit(1), F.length(pointed) - 2), F.lit(":"),
                 F.substring(pointed, -2, 2)),
    ).otherwise(pointed)


def iso_time(text: Column) -> Column:
    """Text of ``iso_text`` to an instant; without an offset it is UTC, other text is null."""
    return F.when(text.rlike(RE_ISO_TIME), text.try_cast("timestamp"))


def iso_offset_minutes(text: Column) -> Column:
    """Offset of ISO time text in minutes, 0 where none is written."""
    sign = F.substring(text, -6, 1)
    minutes = whole_number(F.substring(text, -5, 2)) * 60 + whole_number(
        F.substring(text, -2, 2))
    return F.when(
        (F.length(text) > 16) & sign.isin("+", "-"),
        F.coalesce(F.when(sign == "-", -minutes).otherwise(minutes), F.lit(0)),
    ).otherwise(F.lit(0))


def _json_text(key: str) -> Column:
    return F.try_variant_get(F.col("_json"), f"$['{key}']", "string")


def _json_first(keys: list[str]) -> Column:
    """Value of the first key that is present."""
    present = [F.map_contains_key(F.col("_json_map"), k) for k in keys]
    value = F.lit(None).cast("string")
    for is_there, key in reversed(list(zip(present, keys))):
        value = F.when(is_there, F.col("_json_map")[key]).otherwise(value)
    return value


def _with_identity(df: DataFrame, raw: str, identity: list[str] | None) -> DataFrame:
    """``event_id``: the given one, else a hash of the columns that identify a line."""
    if identity:
        return df.withColumn("event_id", F.sha2(F.concat_ws(
            "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), 256))
    if "event_id" in df.columns:
        return df.withColumn("event_id", F.col("event_id").cast("string"))
    if df.isStreaming:
        raise ValueError("name the columns that identify a line of the stream")
    return df.withColumn("event_id", F.sha2(F.concat_ws(
        "\x1f", raw, "source_host", F.unix_micros("ingested_at"), F.spark_partition_id(),
        F.monotonically_increasing_id()), 256))


def parse_logs(df: DataFrame, raw: str = "raw", reference_year: int | None = None,
               identity: list[str] | None = None) -> DataFrame:
    """One parsed row per line; columns of the input are kept.

    Every line is an event of its own, equal lines too: ``event_id`` is taken from the input
    (``read_logs`` makes it of file and position), or made of the columns named by ``identity``
    (of a queue: topic, partition, offset). A batch with neither gets ids that hold within this
    reading only; a stream is refused.

    Formats are tried in the order RFC 5424, CEF, JSON, RFC 3164, plain text. RFC 3164
    times carry no year: ``reference_year`` or else the year of ``ingested_at`` is taken,
    and an impossible date becomes ``ingested_at``.
    """
    if "ingested_at" not in df.columns:
        df = df.withColumn("ingested_at", F.current_timestamp())
    if "source_host" not in df.columns:
        df = df.withColumn("source_host", F.lit(None).cast("string"))
    df = _with_identity(df, raw, identity)
    kept = [c for c in df.columns if c != raw]

    lines = df.select(*kept, strip(F.coalesce(F.col(raw), F.lit(""))).alias("raw"))
    # one element array of the line itself = "[...]": a second value or trailing text is no object
    lines = lines.withColumn(
        "_variant",
        F.when(
            F.startswith(F.col("raw"), F.lit("{")) & F.endswith(F.col("raw"), F.lit("}")),
            F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]"))),
        ),
    )
    lines = lines.withColumn(
        "log_source",
        F.when(F.col("raw").rlike(RE_RFC5424), "syslog_rfc5424")
        .when(F.col("raw").rlike(RE_CEF), "cef")
        .when(
            F.startswith(F.schema_of_variant(F.try_variant_get("_variant", "$[0]", "variant")),
                         F.lit("OBJECT"))
            & F.try_variant_get("_variant", "$[1]", "variant").isNull(), "json")
        .when(F.col("raw").rlike(RE_RFC3164), "syslog_rfc3164")
        .otherwise("plaintext"),
    )
    source = F.col("log_source")
    is_new, is_old, is_cef, is_json = (
        source == name for name in ("syslog_rfc5424", "syslog_rfc3164", "cef", "json")
    )
    lines = lines.select(
        *kept, "raw", "log_source",
        F.when(is_new, captured(F.col("raw"), RE_RFC5424, 9))
        .when(is_old, captured(F.col("raw"), RE_RFC3164, 6))
        .when(is_cef, F.split(
            F.substring(F.col("raw"), F.instr("raw", "CEF:"), F.length("raw")), r"\|", 9))
        .alias("_part"),
        F.when(is_json, F.try_variant_get("_variant", "$[0]", "variant")).alias("_json"),
        F.when(is_json, F.try_variant_get("_variant", "$[0]", "map<string,string>"))
        .alias("_json_map"),
    )
    part = lambda i: F.get(F.col("_part"), F.lit(i))
    dash = lambda c: F.nullif(c, F.lit("-"))

    # RFC 3164 time: month name, day and clock; a leading element is never empty
    when_old = F.split(part(1), r"(?U)[\s:]+")
    year = F.lit(reference_year) if reference_year else F.year("ingested_at")
    old_time = F.try_make_timestamp(
        year,
        F.coalesce(lookup(MONTHS, when_old[0]), F.lit(1)),
        whole_number(when_old[1]), whole_number(when_old[2]), whole_number(when_old[3]),
        when_old[4].try_cast("decimal(8,6)"), F.lit("UTC"),
    )

    cef_full = is_cef & (F.size("_part") >= 8)
    extension = part(7)
    facility, severity = decode_pri(part(0))
    json_clock = _json_first(JSON_TIME_KEYS)
    json_clock_number = F.coalesce(*[
        F.when(
            F.schema_of_variant(F.try_variant_get("_json", f"$['{k}']", "variant"))
            .rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
            F.try_variant_get("_json", f"$['{k}']", "double"))
        for k in JSON_TIME_KEYS
    ])
    sd = F.when(is_new, part(7))
    lines = lines.select(
        *kept, "raw", "log_source", "_json", "_json_map", "_part",
        F.when(is_new, dash(part(2))).when(is_json & json_clock_number.isNull(), json_clock)
        .alias("_clock"),
        F.when(is_json, json_clock_number).alias("_clock_number"),
        F.when(is_old, old_time).alias("_old_time"),
        F.when(is_new | is_old, facility).alias("facility"),
        F.when(is_new | is_old, severity).when(
            is_json,
            F.coalesce(*[F.when(~_json_text(k).isin("", "0", "false"), _json_text(k))
                         for k in ("level", "severity")]),
        ).alias("severity"),
        F.when(is_new, pairs(all_matches(sd, RE_SD_PARAM, 1), all_matches(sd, RE_SD_PARAM, 2)))
        .when(cef_full, pairs(
            F.transform(all_matches(extension, RE_CEF_EXTENSION, 1), strip),
            F.transform(all_matches(extension, RE_CEF_EXTENSION, 2), strip)))
        .otherwise(F.array().cast(NO_FIELDS)).alias("_found"),
        cef_full.alias("_cef"),
    )
    lines = lines.withColumn("_clock", iso_text(F.col("_clock"))).withColumn(
        "_found_map", last_wins_map("_found"))
    found = lambda k: F.try_element_at(F.col("_found_map"), F.lit(k))
    cef_entries = F.concat(
        F.array(
            entry("cef_version", F.replace(part(0), F.lit("CEF:"), F.lit(""))),
            entry("device_vendor", part(1)), entry("device_product", part(2)),
            entry("device_version", part(3)), entry("signature_id", part(4)),
            entry("name", part(5)), entry("cef_severity", part(6)),
        ),
        F.col("_found"),
        F.filter(
            F.array(
                entry("source_ip", found("src")), entry("dest_ip", found("dst")),
                entry("source_port", whole_number(found("spt"))),
                entry("dest_port", whole_number(found("dpt"))),
            ),
            lambda e: e["value"].isNotNull(),
        ),
    )
    lines = lines.withColumn("_entries", F.when(F.col("_cef"), cef_entries)).withColumn(
        "_iso", iso_time(F.col("_clock")))
    return hold(lines.select(
        *kept, "raw", "log_source",
        F.coalesce(
            F.col("_old_time"),
            F.timestamp_micros(F.round(F.col("_clock_number") * 1000000).try_cast("bigint")),
            F.col("_iso"), F.col("ingested_at"),
        ).alias("timestamp"),
        F.when(F.col("_iso").isNotNull(), iso_offset_minutes(F.col("_clock")))
        .otherwise(0).alias("tz_offset_min"),
        F.coalesce(
            F.when(is_new, dash(part(3))).when(is_old, part(2))
            .when(F.col("_cef"), F.coalesce(found("dhost"), found("shost")))
            .when(is_json, _json_first(JSON_HOST_KEYS)),
            F.lit("unknown"),
        ).alias("host"),
        F.when(is_new, dash(part(4))).when(is_old, part(3)).when(F.col("_cef"), part(2))
        .when(is_json, _json_first(JSON_PROGRAM_KEYS)).alias("program"),
        F.when(is_new, whole_number(part(5), "bigint")).when(is_old, whole_number(part(4), "bigint"))
        .when(is_json, F.try_variant_get("_json", "$.pid", "bigint")).alias("pid"),
        "facility", "severity",
        F.coalesce(
            F.when(is_new, strip(part(8))).when(is_old, strip(part(5)))
            .when(F.col("_cef"), part(5)).when(is_json, _json_first(JSON_MESSAGE_KEYS))
            .when(~is_cef, F.col("raw")),
            F.lit(""),
        ).alias("message"),
        F.coalesce(
            F.when(F.col("_cef"), last_wins_map("_entries")).when(is_json, F.col("_json_map")),
            F.col("_found_map"),
        ).alias("fields"),
        "_json",
    ), kept)
