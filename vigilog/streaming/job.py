"""The whole path as streaming jobs: lines to events, chain fires, anomaly scores and merged alerts.

Three jobs meet in tables of the given folder, so each can stop and go on by itself: events with the
signals of their rules and scores, the signals of chains over stored events, and alerts over all
signals. What a micro-batch writes replaces what an earlier try of it left.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions.hashing import alert_id
from vigilog.operators.alerts import (
    alerts_from_chains, alerts_from_matches, alerts_from_scores, chain_fires_with_text, severity_at_least,
)
from vigilog.operators.forest import Baseline, score
from vigilog.session import checkpointed
from vigilog.sources.catalog import CHAINS, RULES
from vigilog.streaming.detect import LATE, stream_alerts, stream_events, stream_sequences
from vigilog.values import ANOMALY_THRESHOLD, DEDUP_SECONDS

SIGNAL_KEY = ["fingerprint", "event_id", "us", "title", "sigma_rule_id", "chain_id"]


def _written(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _stored(spark: SparkSession, schema, path: str, late: str) -> DataFrame:
    """A table that another job writes, as a stream with a watermark."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path).withWatermark("timestamp", late)


class Detection:
    """Starts the jobs one by one: each needs the tables of the one before to exist.

    ``trigger`` is that of a writer, such as ``{"processingTime": "10 seconds"}``; with
    ``{"availableNow": True}`` a job ends with its input. An alert is written when it has closed.
    """

    def __init__(self, lines: DataFrame, folder: str, rules=RULES, chains=CHAINS, model: Baseline | None = None,
                 late: str = LATE, minimum: str = "low", seconds: int = DEDUP_SECONDS, threshold: float = ANOMALY_THRESHOLD,
                 reference_year: int | None = None, identity: list[str] | None = None, trigger: dict | None = None):
        self.spark, self.folder, self.rules, self.chains, self.model = lines.sparkSession, folder, rules, chains, model
        self.late, self.minimum, self.seconds, self.threshold = late, minimum, seconds, threshold
        self.trigger = trigger or {"processingTime": "10 seconds"}
        self.events = stream_events(lines, rules, late, reference_year=reference_year, identity=identity)
        # the schema of signals does not depend on rows
        self.signals = alerts_from_matches(self.spark.createDataFrame([], self.events.schema), rules).withColumn(
            "timestamp", F.timestamp_micros("us")).schema

    def _start(self, df: DataFrame, name: str, each) -> StreamingQuery:
        return df.writeStream.trigger(**self.trigger).option("checkpointLocation", f"{self.folder}/state/{name}").foreachBatch(
            each).start()

    def _write_signals(self, signals: DataFrame, kind: str, batch: int) -> None:
        _written(severity_at_least(signals, self.minimum).withColumn("timestamp", F.timestamp_micros("us")),
                 f"{self.folder}/signals/{kind}", batch)

    def start_events(self) -> StreamingQuery:
        """Events to ``events``, the signals of rules and scores to ``signals/rules`` and ``signals/scores``."""
        def each(rows: DataFrame, batch: int) -> None:
            rows = checkpointed(rows)
            self._write_signals(alerts_from_matches(rows, self.rules), "rules", batch)
            if self.model is not None:
                self._write_signals(alerts_from_scores(score(rows, self.model, self.threshold)), "scores", batch)
            _written(rows, f"{self.folder}/events", batch)

        return self._start(self.events, "events", each)

    def start_chains(self) -> StreamingQuery:
        """The signals of chains over the stored events to ``signals/chains``."""
        def each(fires: DataFrame, batch: int) -> None:
            fires = checkpointed(fires.withColumn("steps", F.transform("step_events", lambda e: F.struct(e.alias("event_id")))))
            first, last = fires.agg(F.min("first_us"), F.max("us")).first()
            if first is None:
                return
            near = self.spark.read.schema(self.events.schema).option("recursiveFileLookup", "true").parquet(
                f"{self.folder}/events").where(F.col("us").between(first, last))
            texts = chain_fires_with_text(fires, near, self.chains)
            self._write_signals(alerts_from_chains(texts, self.chains), "chains", batch)

        events = _stored(self.spark, self.events.schema, f"{self.folder}/events", self.late)
        return self._start(stream_sequences(events, self.chains, lock_seconds=self.seconds), "chains", each)

    def start_alerts(self) -> StreamingQuery:
        """Closed alerts over all signals, with their ids, to ``alerts``."""
        signals = _stored(self.spark, self.signals, f"{self.folder}/signals", self.late)
        once = signals.dropDuplicatesWithinWatermark(SIGNAL_KEY)  # a batch that was tried twice
        closed = stream_alerts(once, self.seconds).where("status = 'closed'").drop("status", "timestamp").withColumn(
            "alert_id", alert_id(F.col("fingerprint"), F.concat_ws(":", "event_id", "us")))
        return self._start(closed, "alerts", lambda rows, batch: _written(rows, f"{self.folder}/alerts", batch))

    def run(self) -> None:
        """All jobs over what there is, one after the other; for ``availableNow``."""
        for start in (self.start_events, self.start_chains, self.start_alerts):
            start().awaitTermination()
