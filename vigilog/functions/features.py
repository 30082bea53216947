"""The 31 features of an event, each a column expression in [0, 1]."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.hashing import stable_hash
from vigilog.functions.net import is_rfc1918, port_bucket
from vigilog.functions.text import lookup, whole_number
from vigilog.values import (
    AUTH_PROGRAMS, COMMON_PORTS, FACILITY_CODE, FEATURE_NAMES, LOG_SOURCE_CODE, NETWORK_PROGRAMS,
    RE_FEATURE_FAIL, RE_FEATURE_IP, RE_FEATURE_SUCCESS, RE_PATH, SEVERITY_CODE, WEB_SERVERS,
)

DAY_US = 86_400_000_000


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def local_clock(timestamp: Column, offset_minutes: Column) -> tuple[Column, Column, Column]:
    """(hour, minute, weekday with Monday 0) on the clock of the event's own offset."""
    local = F.unix_micros(timestamp) + F.coalesce(offset_minutes, F.lit(0)).cast("bigint") * \
        60_000_000
    of_day = F.pmod(local, F.lit(DAY_US))
    hour = F.floor(of_day / F.lit(3_600_000_000))
    minute = F.floor(F.pmod(of_day, F.lit(3_600_000_000)) / F.lit(60_000_000))
    weekday = F.pmod(F.floor(local / F.lit(DAY_US)) + 3, F.lit(7))  # 1970-01-01: Thursday
    return hour, minute, weekday


def feature_columns() -> dict[str, Column]:
    c = F.col
    hour, minute, weekday = local_clock(c("timestamp"), c("tz_offset_min"))
    has_ip = F.coalesce(c("source_ip") != "", F.lit(False))
    octet = whole_number(F.substring_index("source_ip", ".", 1))
    port = F.coalesce("dest_port", F.lit(0))
    has_port = port != 0
    program = F.lower(F.coalesce("program", F.lit("")))
    message = F.coalesce("message", F.lit(""))
    severity = F.lower(F.coalesce("severity", F.lit("")))
    facility = F.lower(F.coalesce("facility", F.lit("")))
    share = lambda port: F.least(port / F.lit(65535.0), F.lit(1.0))
    values = [
        hour / F.lit(23.0), minute / F.lit(59.0), flag(weekday >= 5),
        flag((hour < 6) | (hour >= 22)), flag(hour.between(8, 17) & (weekday < 5)),
        flag(has_ip), F.when(has_ip, F.coalesce(octet, F.lit(0)) / F.lit(255.0)).otherwise(0.0),
        flag(is_rfc1918(c("source_ip"))), share(port),
        share(F.coalesce("source_port", F.lit(0))),
        flag(port.isin(COMMON_PORTS)), flag(has_port & (port > 1024)),
        flag(has_port & (port <= 1024)),
        F.when(has_port, port_bucket(port)).otherwise(0.0), flag(has_port),
        F.coalesce(lookup(LOG_SOURCE_CODE, c("log_source")), F.lit(0.5)),
        flag(program.isin(AUTH_PROGRAMS)), flag(program.isin(NETWORK_PROGRAMS + WEB_SERVERS)),
        stable_hash(program), flag(c("pid").isNotNull()),
        F.least(F.length(message) / F.lit(512.0), F.lit(1.0)),
        flag(message.rlike(RE_FEATURE_IP)), flag(message.rlike(RE_FEATURE_FAIL)),
        flag(message.rlike(RE_FEATURE_SUCCESS)), flag(message.rlike(RE_PATH)),
        F.coalesce(lookup(SEVERITY_CODE, severity), F.lit(0.0)),
        F.when(facility == "", 0.0).otherwise(
            F.coalesce(lookup(FACILITY_CODE, facility), F.lit(0.1))),
        flag(severity != ""), flag(severity.isin("emerg", "alert", "crit", "err")),
        flag(severity.isin("notice", "info", "debug")),
        F.least(F.size(F.coalesce("tags", F.array().cast("array<string>"))) / F.lit(10.0),
                F.lit(1.0)),
    ]
    return {n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in zip(FEATURE_NAMES, values)}


def features(events: DataFrame, keep=None) -> DataFrame:
    """Kept columns and the 31 feature columns."""
    keep = events.columns if keep is None else list(keep)
    columns = feature_columns()
    return events.select(*keep, *[v.alias(n) for n, v in columns.items()])


def top_features(baseline: list[float] | None = None, n: int = 5) -> Column:
    """The n features furthest from the baseline mean, ties in feature order."""
    rows = F.array(*[
        F.struct(
            (-(F.abs(F.col(name) - F.lit(baseline[i])) if baseline else F.col(name))).alias("d"),
            F.lit(i).alias("i"), F.lit(name).alias("feature"))
        for i, name in enumerate(FEATURE_NAMES)
    ])
    return F.transform(
        F.slice(F.sort_array(rows), 1, n),
        lambda r: F.struct(r["feature"].alias("feature"), (-r["d"]).alias("deviation")))
