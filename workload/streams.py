"""The streaming jobs, each run to the end of its input and compared with the batch result."""

import os
import uuid

from pyspark.sql import functions as F

from vigilog.session import shared_folder
from vigilog.sources.catalog import RULES
from vigilog.sources.lines import stream_logs
from vigilog.streaming.detect import (
    RuleFolder, live_counts, stream_alerts, stream_events, stream_sequences, write_batch,
)
from workload.base import (
    LOCK_SECONDS, LONG_CHAINS, REFERENCE_YEAR, events, ev, fired, hits, log_lines, query,
    rule_signals, stage, table,
)


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream, spark, mode="append"):
    """Run a stream over all its input and read back what it wrote."""
    out = folder(spark)
    schema = stream.schema
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", out + "/state").format("parquet").start(out + "/data").awaitTermination()
    return spark.read.schema(schema).parquet(out + "/data")


def as_stream(df):
    """A written table read as a stream."""
    path = os.path.dirname(df.inputFiles()[0])
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


ROWS_PER_FILE = 25_000


def write_micro_batches(df, parts, path):
    """Writes the rows of each condition of ``parts`` as one micro-batch and returns the files of each,
    as many for all: so many that the smallest has ``ROWS_PER_FILE`` rows a file, and one at least."""
    counts = df.agg(*[F.count_if(part) for part in parts]).first()
    files = max(1, min(counts) // ROWS_PER_FILE)
    for part in parts:  # files are read in the order in which they were written
        rows = df.where(part)
        (rows.repartition(files, "event_id") if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return files


MICRO_BATCHES = 4
LATE_HOURS = 20  # rows arrive up to so much later than they happened


def arriving(df, key, after):
    """All rows of a written table as a stream of several micro-batches, many of them late and out of order; a
    last row of another ``key``, ``after`` seconds past the others, moves the watermark past all of them."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    delay = F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * 3600)) * 1_000_000
    rows = df.withColumn("_arrival", F.col("us") + delay)
    ends = rows.agg(F.min("_arrival"), F.max("_arrival"), F.max("us")).first()
    width = (ends[1] - ends[0]) // MICRO_BATCHES + 1
    lows = [ends[0] + k * width for k in range(MICRO_BATCHES)]
    files = write_micro_batches(rows, [F.col("_arrival").between(low, low + width - 1) for low in lows], path)
    end = ends[2] + (LATE_HOURS * 3600 + 86400 + after) * 1_000_000
    rows.drop("_arrival").limit(1).withColumns({
        key: F.lit("end"), "us": F.lit(end), "timestamp": F.timestamp_micros(F.lit(end)), "event_id": F.lit("end")}).write.mode(
        "append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark("timestamp", "1 day")


def line_stream(spark, sf):
    lines = stage(spark, sf, "raw_lines", lambda: log_lines(spark, sf))
    return as_stream(lines)


@query("s2_stream_logs", ev("""SELECT 'localhost' AS source_host, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS chars FROM ev"""))
def logs(spark, sf):
    path = folder(spark)
    log_lines(spark, sf).select("raw").write.text(path)
    return drained(stream_logs(spark, path), spark).groupBy("source_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars"))


@query("r1_streaming_detect", hits("SELECT title, count(*) AS n FROM hits GROUP BY title"))
def detect(spark, sf):
    rows = stream_events(line_stream(spark, sf), RULES, reference_year=REFERENCE_YEAR)
    return drained(rows.select("event_id", "sigma_matches"), spark).select(
        F.explode("sigma_matches").alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


KEPT_SECONDS = max(LOCK_SECONDS, *(c["window_seconds"] for c in LONG_CHAINS))


def streamed_fires(spark, sf):
    """Fires of the chains over several micro-batches with late rows and expiring state."""
    return stage(spark, sf, "streamed_fires", lambda: drained(stream_sequences(
        arriving(events(spark, sf), "source_key", KEPT_SECONDS), LONG_CHAINS, lock_seconds=LOCK_SECONDS), spark))


@query("r2_streaming_sequences", fired("SELECT chain_id, source_key, event_id, us, first_us FROM fires"))
def sequences(spark, sf):
    return streamed_fires(spark, sf).select("chain_id", "source_key", "event_id", "us", "first_us")


@query("r3_state_rows", fired("SELECT chain_id, count(*) AS fires, CAST(sum(length(letters)) AS BIGINT) AS steps FROM fires "
                             "JOIN chains USING (chain_id) GROUP BY chain_id"))
def state_rows(spark, sf):
    return streamed_fires(spark, sf).groupBy(
        "chain_id").agg(F.count(F.lit(1)).alias("fires"), F.sum(F.size("step_events")).alias("steps"))


GAP_SECONDS = 43200


@query("r4_streaming_dedup", hits(f"""SELECT min_by(event_id, (us, event_id)) AS event_id, fingerprint, min(us) AS first_us,
    max(us) AS last_us, count(*) AS hit_count
  FROM (SELECT *, sum((gap IS NULL OR gap >= {GAP_SECONDS}000000)::INT) OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS island
    FROM (SELECT *, us - lag(us) OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS gap
      FROM (SELECT *, sha256('sigma:' || source_key || ':' || title)[1:16] AS fingerprint FROM hits)))
  GROUP BY fingerprint, island"""))
def dedup(spark, sf):
    signals = stage(spark, sf, "signal_rows", lambda: rule_signals(spark, sf).select(
        "fingerprint", "us", "event_id", "title", F.timestamp_micros("us").alias("timestamp")))
    alerts = drained(stream_alerts(arriving(signals, "fingerprint", GAP_SECONDS), GAP_SECONDS), spark)
    return alerts.where("status = 'closed'").select("event_id", "fingerprint", "first_us", "last_us", "hit_count")


@query("r5_streaming_throttle", fired("SELECT chain_id, source_key, us FROM fires"))
def throttle(spark, sf):
    return streamed_fires(spark, sf).select("chain_id", "source_key", "us")


@query("r6_live_counts", hits("""SELECT us // 2000000 * 2 AS tick, count(DISTINCT ev.event_id) AS events, count(h.title) AS rule_hits
  FROM (SELECT event_id, us FROM ev) ev LEFT JOIN (SELECT event_id, title FROM hits) h USING (event_id) GROUP BY ALL"""))
def live(spark, sf):
    out = folder(spark)
    counts = live_counts(as_stream(events(spark, sf)).withWatermark("timestamp", "1 minute"))
    counts.writeStream.outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation", out + "/state").foreachBatch(
        lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(
            out + "/data")).start().awaitTermination()
    last = spark.read.parquet(out + "/data").groupBy("tick").agg(
        F.max_by(F.struct("events", "rule_hits"), "batch").alias("x"))
    return last.select(F.unix_seconds("tick").alias("tick"), "x.events", "x.rule_hits")


@query("r7_rule_refresh", ev("""SELECT id % 3 AS batch, count(*) AS n FROM ev WHERE CASE id % 3 WHEN 0
    THEN contains(lower(message), 'port scan') ELSE contains(lower(message), 'failed password') END GROUP BY ALL"""))
def refresh(spark, sf):
    """Three micro-batches: a rule, the rule with another keyword, and the same beside a broken one."""
    rules, path, out = folder(spark), folder(spark), folder(spark)

    def offer(text, mode):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(rules)

    def rule(word):
        return (f"title: Watched\nid: a1\nlogsource: {{}}\nlevel: low\ntags: [attack.t1046]\ndetection:\n"
                f"  k: ['{word}']\n  condition: k")

    plain = events(spark, sf).withColumn("sigma_matches", F.array().cast("array<string>"))
    files = write_micro_batches(plain, [F.col("event_id").cast("bigint") % 3 == k for k in range(3)], path)
    offer(rule("port scan"), "overwrite")
    watched = RuleFolder(spark, rules, "*.txt")  # as the text writer names its files
    match = watched.each_batch(lambda df, batch: df.select(F.explode("sigma_matches").alias("title"), F.lit(batch).alias("batch")).write.mode(
        "append").parquet(out + "/data"))

    def run(df, batch):
        if batch == 1:
            offer(rule("failed password"), "overwrite")
        if batch == 2:
            offer("title: [", "append")
        match(df, batch)

    spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", files).parquet(path).writeStream.trigger(
        availableNow=True).option("checkpointLocation", out + "/state").foreachBatch(run).start().awaitTermination()
    return spark.read.parquet(out + "/data").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("r8_streaming_sinks", hits("""SELECT (SELECT count(*) FROM ev) AS events, count(*) AS alerts, count(*) AS bundles
  FROM (SELECT us - lag(us) OVER (PARTITION BY source_key, title ORDER BY us, event_id) AS gap FROM hits)
  WHERE gap IS NULL OR gap >= 300000000"""))
def sinks(spark, sf):
    out = folder(spark)
    write = write_batch(out, RULES)

    def twice(df, batch):  # a micro-batch that fails after it has written is run again
        write(df, batch)
        write(df, batch)

    as_stream(events(spark, sf)).writeStream.trigger(availableNow=True).option(
        "checkpointLocation", out + "/state").foreachBatch(twice).start().awaitTermination()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    return n(spark.read.parquet(out + "/events"), "events").join(
        n(spark.read.schema("alert_id string").json(out + "/alerts"), "alerts"), "_one").join(
        n(spark.read.text(out + "/bundles"), "bundles"), "_one").drop("_one")
