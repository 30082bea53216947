"""Detection on streams: the batch functions, and state per source and per fingerprint."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators.alerts import alerts_from_matches, merge_alerts, with_alert_id
from vigilog.operators.normalize import normalize, source_key
from vigilog.operators.parse import parse_logs
from vigilog.operators.quality import rule_findings
from vigilog.operators.rules import enrich_with_matches
from vigilog.operators.sequence import chain_steps
from vigilog.session import checkpointed
from vigilog.sources.catalog import CHAINS, techniques_table
from vigilog.sources.events import write_events
from vigilog.sources.rules import file_snapshot, load_rule_set, read_rules, rule_matchers, rules_changed
from vigilog.sources.sinks import write_alert_log, write_stix_bundles
from vigilog.streaming.ordered import ALERT_SCHEMA, BUCKETS, FIRE_SCHEMA, AlertProcessor, SequenceProcessor
from vigilog.values import DEDUP_SECONDS, WINDOW_CAP

LATE = "10 minutes"


def stream_events(lines: DataFrame, rules: list[dict], late: str = LATE, once: bool = True,
                  reference_year: int | None = None, identity: list[str] | None = None) -> DataFrame:
    """Parsed, normalized and matched events of a stream of lines.

    Event time decides; rows later than ``late`` are dropped by the stateful steps behind. A line
    is known by ``event_id`` or by the columns named by ``identity``, never by its text: equal
    lines are as many events, and only one delivered twice counts once.
    """
    parsed = parse_logs(lines, reference_year=reference_year, identity=identity)
    events = enrich_with_matches(normalize(parsed), rules)
    events = events.drop("fired").withColumn("source_key", source_key()).withColumn(
        "us", F.unix_micros("timestamp")).withWatermark("timestamp", late)
    return events.dropDuplicatesWithinWatermark(["event_id"]) if once else events


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


# -- sequences -------------------------------------------------------------------------------

def stream_sequences(events: DataFrame, chains=CHAINS, cap: int = WINDOW_CAP,
                     lock_seconds: float = DEDUP_SECONDS) -> DataFrame:
    """Fires of attack chains, as in a batch, of the events that the watermark has passed.

    An event that the watermark lets in is never too late for a window, in whatever micro-batch
    it comes. The state of a silent source expires when neither a window nor a lockout can reach
    back to it.
    """
    spec, masks = [], []
    for chain_id, seconds, steps in chain_steps(chains):
        spec.append((chain_id, int(seconds * 1_000_000), len(steps)))
        mask = F.lit(0).cast("bigint")
        for bit, step in enumerate(steps):  # bits of one chain: its own number of steps is the limit
            mask = mask + F.when(step, F.lit(1 << bit).cast("bigint")).otherwise(0)
        masks.append(mask)
    rows = events.select(bucket("source_key"), "source_key", "us", "event_id", "timestamp", *[
        m.alias(f"m{c}") for c, m in enumerate(masks)])
    return rows.groupBy("bucket").transformWithStateInPandas(
        SequenceProcessor(spec, cap, int(lock_seconds * 1_000_000)), FIRE_SCHEMA, "append", "eventTime")


# -- alerts ----------------------------------------------------------------------------------

EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stream_alerts(signals: DataFrame, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Merged hits of each fingerprint, as in a batch: the columns of its first hit, ``status``,
    ``hit_count``, ``first_us`` and ``last_us``.

    An alert has a row of status ``first`` when its first hit is sure, and one of status ``closed``,
    with the final figures, when the watermark has passed its last hit by ``seconds``. Needs
    ``fingerprint``, ``us``, ``event_id`` and a watermark on ``timestamp``.
    """
    rows = signals.select(bucket("fingerprint"), "fingerprint", "us", "event_id", "timestamp",
                          F.to_json(F.struct(*signals.columns), EXACT_TIMES).alias("row"))
    merged = rows.groupBy("bucket").transformWithStateInPandas(
        AlertProcessor(seconds * 1_000_000), ALERT_SCHEMA, "append", "eventTime")
    return merged.withColumn("row", F.from_json("row", signals.schema, EXACT_TIMES)).select(
        "row.*", "status", "hit_count", "first_us", "last_us")


def stream_first_alerts(signals: DataFrame, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """The first hit of each alert of ``stream_alerts``."""
    return stream_alerts(signals, seconds).where("status = 'first'").select(signals.columns)


def live_counts(events: DataFrame, seconds: int = 2) -> DataFrame:
    """Events and rule hits per tick; in update mode the running numbers."""
    return events.groupBy(F.window("timestamp", f"{seconds} seconds").alias("tick")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.size("sigma_matches")).alias("rule_hits")
    ).select(F.col("tick.start").alias("tick"), "events", "rule_hits",
             (F.col("events") / seconds).alias("events_per_sec"))


def write_batch(folder: str, rules: list[dict], minimum: str = "low", seconds: int = DEDUP_SECONDS):
    """``foreachBatch`` function: events to the store, their merged rule alerts to the log and bundles.

    A micro-batch is parsed once, its alerts are merged and named as in a batch, and all is written
    below ``batch=<id>`` in place of what an earlier try of it left: a replay changes nothing.
    """

    def write(events: DataFrame, batch: int) -> None:
        rows = checkpointed(events.drop("source_key", "us"))
        alerts = checkpointed(merge_alerts(alerts_from_matches(rows, rules), minimum, seconds))
        write_events(with_alert_id(rows, alerts), f"{folder}/events/batch={batch}", "overwrite")
        write_alert_log(alerts, f"{folder}/alerts/batch={batch}", "overwrite")
        write_stix_bundles(alerts, f"{folder}/bundles/batch={batch}", "overwrite")

    return write


class RuleFolder:
    """The rules of a folder, taken anew when files changed and none has an error.

    Called once per micro-batch. Only names and times of the files are looked at until one of them
    changes; a set with an error leaves the one before in force, and ``errors`` (source, message)
    tells all that is wrong with it.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = "*.yml"):
        self.spark, self.path, self.pattern = spark, path, pattern
        self.rules: list[dict] = []
        self.errors: DataFrame | None = None
        self._seen: DataFrame | None = None
        self.refresh()

    def refresh(self) -> bool:
        now = checkpointed(file_snapshot(self.spark, self.path, self.pattern))
        if self._seen is not None and rules_changed(self._seen, now).isEmpty():
            return False
        self._seen = now
        table = checkpointed(read_rules(self.spark, self.path, self.pattern))
        usable = table.where("error is null")
        found = rule_findings(usable, rule_matchers(usable), techniques_table(self.spark))
        self.errors = checkpointed(
            table.where("error is not null").select(F.col("source_file").alias("source"), F.col("error").alias("message"))
            .unionByName(found.where("severity = 'ERROR'").select(
                F.lit(self.path).alias("source"), "message")))
        if not self.errors.isEmpty():
            return False
        self.rules = load_rule_set(table)
        return True

    def each_batch(self, then):
        """``foreachBatch`` function that hands (parsed events, rules in force) on."""

        def run(events: DataFrame, batch: int) -> None:
            self.refresh()
            then(enrich_with_matches(events, self.rules), batch)

        return run
