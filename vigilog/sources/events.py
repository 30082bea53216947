"""The event store: typed columns to filter on, the whole event as JSON beside them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_rows(events: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(*[c for c in events.columns if not c.startswith("_")]))
    return events.select(
        "event_id", "timestamp", "host", "program", "log_source", "severity",
        F.substring("message", 1, 512).alias("message"),
        F.col("alert_id").isNotNull().cast("int").alias("has_alert"),
        F.to_json("sigma_matches").alias("sigma_hits"), "anomaly_score",
        F.to_json("tags").alias("tags"), payload.alias("payload"),
        F.to_date("timestamp").alias("event_date"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    store_rows(events).write.mode(mode).partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


RADIX = 1024          # slots of one digit, of which only counts reach the driver
RANKED_ROWS = 100_000  # rows of the last slot, of which the newest are sorted out


def retain_newest(df: DataFrame, n: int, us: str, tie: list[str], radix: int = RADIX,
                  ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """The newest ``n`` rows; of equal times those of larger ``tie``.

    The instant where the limit falls is found digit by digit: rows are counted in ``radix`` slots,
    then in slots of the one that holds the limit, until it is one instant or holds few rows. Rows
    after it are kept as they are; of those inside only the missing ones are sorted out. Rows without
    a time are not kept.
    """
    low, high, total = df.agg(F.min(us), F.max(us), F.count(us)).first()
    if n <= 0 or not total:
        return df.limit(0)
    if total <= n:
        return df.where(F.col(us).isNotNull())
    missing, inside = n, total  # of the rows between low and high
    while inside > ranked_rows and high > low:
        width = (high - low) // radix + 1
        slots = df.where(F.col(us).between(low, high)).groupBy(
            F.floor((F.col(us) - F.lit(low)) / F.lit(width)).alias("slot")).count().collect()
        for slot, rows in sorted(((r["slot"], r["count"]) for r in slots), reverse=True):
            if rows >= missing:
                low, high, inside = low + slot * width, min(high, low + (slot + 1) * width - 1), rows
                break
            missing -= rows
    part = df.where(F.col(us).between(low, high)).orderBy(F.desc(us), *map(F.desc, tie)).limit(missing)
    return df.where(F.col(us) > high).unionByName(part)


def recent_events(df: DataFrame, host: str | None = None, has_alert: bool | None = None,
                  limit: int = 100, offset: int = 0, newest=("timestamp", "event_id")
                  ) -> DataFrame:
    """A page of the newest stored events."""
    if host:
        df = df.where(F.col("host") == host)
    if has_alert is not None:
        df = df.where(F.col("has_alert") == int(has_alert))
    return df.orderBy(*[F.desc(c) for c in newest]).offset(offset).limit(limit)


def search_events(events: DataFrame, text: str | None = None, anomalous: bool = False,
                  threshold: float = 0.62) -> DataFrame:
    """Events that show the text in message or host (any case) or in the source address."""
    if text:
        low = F.lit(text.lower())
        events = events.where(
            F.coalesce(F.contains(F.lower("message"), low), F.lit(False))
            | F.coalesce(F.contains(F.lower("host"), low), F.lit(False))
            | F.coalesce(F.contains(F.col("source_ip"), F.lit(text)), F.lit(False)))
    if anomalous:
        events = events.where(F.col("anomaly_score") >= threshold)
    return events


def event_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("events"))
