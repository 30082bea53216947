"""Where alerts go: a day-partitioned JSON log and STIX bundles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.stix import bundle

DAY = "alert_date"


def with_day(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(DAY, F.to_date(F.timestamp_micros("us")))


def write_alert_log(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per alert, one set of files per day."""
    with_day(alerts).write.mode(mode).partitionBy(DAY).json(path)


def stix_bundles(alerts: DataFrame, created=None) -> DataFrame:
    """(alert_id, alert_date, value): the bundle of each alert as JSON text."""
    made = F.current_timestamp() if created is None else created
    return with_day(alerts).select("alert_id", DAY, bundle(made).alias("value"))


def write_stix_bundles(alerts: DataFrame, path: str, mode: str = "append") -> None:
    stix_bundles(alerts).select(DAY, "value").write.mode(mode).partitionBy(DAY).text(path)
