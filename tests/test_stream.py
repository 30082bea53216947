"""Streams in several micro-batches against the batch functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators.alerts import alerts_from_matches, merge_alerts
from vigilog.operators.dedup import dedup_gap
from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import enrich_with_matches
from vigilog.plans.detect import find_chains
from vigilog.sources.catalog import CHAINS, RULES
from vigilog.sources.lines import stream_logs
from vigilog.streaming.detect import (
    RuleFolder, stream_alerts, stream_events, stream_first_alerts, stream_sequences, write_batch,
)
from vigilog.streaming.ordered import ChainFold

WORDS = ["Failed password", "Accepted password", "Port Scan", "/admin", "uid=0", "nothing"]


def events(spark):
    rng = random.Random(5)
    data = [(f"{i:05d}", f"10.0.0.{rng.randrange(3)}", (i + 1000) * 7_000_000, rng.choice(WORDS)) for i in range(900)]
    return spark.createDataFrame(data, "event_id string, source_ip string, us bigint, message string").select(
        "*", F.timestamp_micros("us").alias("timestamp"), F.col("source_ip").alias("host"),
        F.lit(None).cast("string").alias("program"), F.array().cast("array<string>").alias("tags"),
        F.array().cast("array<string>").alias("sigma_matches"), F.col("source_ip").alias("source_key"))


def streamed(spark, df, tmp_path, build, parts=4, part=None, late="1 minute"):
    """Files in time order (or by ``part``), one micro-batch each, and a last row that moves the watermark past all."""
    path = str(tmp_path / "in")
    part = F.floor(F.col("event_id").cast("int") / 225) if part is None else part
    end = df.agg(F.max("us")).first()[0] + 10**11
    last = df.limit(1).withColumns({"us": F.lit(end), "timestamp": F.timestamp_micros(F.lit(end)), "event_id": F.lit("end"),
                                    **{c: F.lit("end") for c in df.columns if c in ("source_key", "fingerprint", "message")}})
    for k in range(parts):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    last.write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = build(source.withWatermark("timestamp", late))
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format(
        "parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    streamed.progress = [p for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_sequences(spark, tmp_path):
    df = events(spark)
    want = {(r.chain_id, r.source_key, r.us, r.first_us, tuple(s.event_id for s in r.steps))
            for r in find_chains(df, CHAINS).collect()}
    got = {(r.chain_id, r.source_key, r.us, r.first_us, tuple(r.step_events))
           for r in streamed(spark, df, tmp_path, lambda s: stream_sequences(s, CHAINS)).collect()}
    assert got == want and len(want) > 20


def fires_of(spark, df, tmp_path, chains=CHAINS, **options):
    got = streamed(spark, df, tmp_path, lambda s: stream_sequences(s, chains), **options)
    return {(r.chain_id, r.source_key, r.us, r.first_us, tuple(r.step_events)) for r in got.collect()}


def batch_fires(df, chains=CHAINS):
    return {(r.chain_id, r.source_key, r.us, r.first_us, tuple(s.event_id for s in r.steps)) for r in find_chains(df, chains).collect()}


def test_late_rows_fire_as_in_a_batch(spark, tmp_path):
    """Step 1 at 100 s and a row at 1,200 s, then, late but within the watermark, step 2 at 650 s."""
    chain = {"id": "c", "title": "c", "window_seconds": 600, "steps": [("one", ["first step"]), ("two", ["second step"])]}
    at = {"a": (100, "first step"), "b": (1200, "nothing"), "c": (650, "second step"), "d": (1190, "second step")}
    df = events(spark).limit(4).select("source_ip", "host", "program", "tags", "sigma_matches", "source_key")
    rows = spark.createDataFrame([(i, s * 1_000_000, m) for i, (s, m) in at.items()], "event_id string, us bigint, message string")
    df = rows.join(df.limit(1)).select("event_id", "us", "message", F.timestamp_micros("us").alias("timestamp"), *df.columns)
    part = F.when(F.col("event_id").isin("a", "b"), 0).otherwise(1)
    got = fires_of(spark, df, tmp_path, [chain], parts=2, part=part, late="10 minutes")
    assert got == batch_fires(df, [chain]) and {g[2] for g in got} == {650_000_000}


def test_rows_in_any_order_within_the_watermark(spark, tmp_path):
    df = events(spark)
    delay = F.pmod(F.xxhash64("event_id"), F.lit(500)) * 1_000_000  # up to 500 s late, over six micro-batches
    part = F.floor((F.col("us") + delay - 7_000_000_000) / 1_200_000_000)
    got = fires_of(spark, df, tmp_path, parts=6, part=part, late="10 minutes")
    assert got == batch_fires(df) and len(got) > 20
    keys = [p.stateOperators[0].numRowsTotal for p in streamed.progress if p.stateOperators]
    assert max(keys) >= 6 and keys[-1] <= 1, keys  # waiting rows and past of three sources; in the end the last row waits


def test_a_row_costs_the_same_whatever_the_window():
    """The fold of a source looks at its past rows only where a chain fires."""
    spec = [("never", 10**15, 3)]
    fold, seen = ChainFold(spec, 500, 10), 0
    for i in range(2000):
        seen += len(list(fold.add(i, str(i), [i % 2])))
    assert seen == 0 and len(fold.ring) == 500
    again = ChainFold(spec, 500, 10, fold.past())
    assert list(again.add(3000, "x", [2])) == [] and list(again.add(3001, "y", [4]))[0][1:3] == (3001, "y")


def test_closed_alerts_equal_the_batch(spark, tmp_path):
    df = events(spark).select("event_id", "us", "timestamp", "tags", F.col("message").alias("fingerprint"))
    df = df.unionByName(df.where("fingerprint = 'uid=0'").withColumn("event_id", F.concat("event_id", F.lit("x"))))  # equal times
    delay = F.pmod(F.xxhash64("event_id"), F.lit(500)) * 1_000_000
    part = F.floor((F.col("us") + delay - 7_000_000_000) / 1_200_000_000)
    got = streamed(spark, df, tmp_path, lambda s: stream_alerts(s, 30), parts=6, part=part, late="10 minutes").collect()
    want = {tuple(r) for r in dedup_gap(df.select("event_id", "us", "fingerprint"), ["fingerprint"], "us", 30, ["event_id"]).select(
        "event_id", "fingerprint", "us", "hit_count", "first_us", "last_us").collect()}
    of = lambda status: {(r.event_id, r.fingerprint, r.us, r.hit_count, r.first_us, r.last_us) for r in got if r.status == status}
    assert of("closed") == want and len(want) > 50 and max(w[3] for w in want) > 3
    assert {g[:3] for g in of("first")} == {w[:3] for w in want} and len(got) == 2 * len(want)
    assert all(r.timestamp is not None and r.tags == [] for r in got)


def test_first_alerts(spark, tmp_path):
    df = events(spark).select("event_id", "us", "timestamp", F.concat("source_ip", "message").alias("fingerprint"))
    want = {r.event_id for r in dedup_gap(df, ["fingerprint"], "us", 100, ["event_id"]).collect()}
    got = {r.event_id for r in streamed(spark, df, tmp_path, lambda s: stream_first_alerts(s, 100)).collect()}
    assert got == want


def test_lockout_outlives_the_window(spark, tmp_path):
    """A chain of a 120 s window that fires again within its 300 s lockout, long after the rows expired."""
    chain = next(c for c in CHAINS if c["window_seconds"] == min(x["window_seconds"] for x in CHAINS))
    base = events(spark)
    want = [(r.chain_id, r.us) for r in find_chains(base, [chain], lock_seconds=3000).collect()]
    got = [(r.chain_id, r.us) for r in streamed(
        spark, base, tmp_path, lambda s: stream_sequences(s, [chain], lock_seconds=3000)).collect()]
    assert sorted(got) == sorted(want) and want
    assert len(find_chains(base, [chain], lock_seconds=1).collect()) > len(want)


def test_equal_lines_and_redelivery(spark, tmp_path):
    line = "<34>1 2025-03-09T04:11:30Z relay-2 sshd 5150 - - Failed password for pia from 198.51.100.41 port 2200\n"
    src = tmp_path / "src"
    (src / "in").mkdir(parents=True)
    (src / "late").mkdir()
    (src / "in" / "a.log").write_text(line * 3)

    def run():
        lines = stream_logs(spark, str(src / "*"), by_name=True)
        rows = stream_events(lines, RULES).select("event_id", "message")
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state_")).format(
            "parquet").start(str(tmp_path / "out_")).awaitTermination()
        return spark.read.schema(rows.schema).parquet(str(tmp_path / "out_")).count()

    assert run() == 3
    (src / "late" / "a.log").write_text(line * 3)  # the same file once more
    (src / "in" / "b.log").write_text(line)
    assert run() == 4
    with pytest.raises(ValueError):
        stream_events(spark.readStream.text(str(src / "in")).withColumnRenamed("value", "raw"), RULES)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    start = dt.datetime(2025, 3, 9, 4)
    rows = [(f"e{i}", "Failed password for pia from 198.51.100.41 port 2200", start + dt.timedelta(seconds=20 * i))
            for i in range(4)]
    df = enrich_with_matches(normalize(parse_logs(spark.createDataFrame(
        rows, "event_id string, raw string, ingested_at timestamp"))), RULES).drop("fired")
    write = write_batch(str(tmp_path), RULES)
    for batch in (0, 1, 1):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "events")).where("batch = 1").count() == 4
    log = spark.read.json(str(tmp_path / "alerts")).where("batch = 1").collect()
    want = merge_alerts(alerts_from_matches(df, RULES)).collect()
    assert {r.alert_id for r in log} == {r.alert_id for r in want} and len(log) == len(want) >= 1
    assert spark.read.text(str(tmp_path / "bundles")).where("batch = 1").count() == len(want)


def test_rule_folder_swaps_whole_sets_only(spark, tmp_path):
    rule = "title: T{0}\nid: {0}\nlogsource: {{}}\nlevel: low\ntags: [attack.t1046]\ndetection:\n  k: [x]\n  condition: k"
    (tmp_path / "a.yml").write_text(rule.format(1))
    folder = RuleFolder(spark, str(tmp_path))
    assert [r["id"] for r in folder.rules] == ["1"] and not folder.refresh()
    for i in range(120):
        (tmp_path / f"bad{i}.yml").write_text("title: [")
    assert not folder.refresh() and folder.errors.count() == 120 and [r["id"] for r in folder.rules] == ["1"]
    for i in range(120):
        (tmp_path / f"bad{i}.yml").unlink()
    (tmp_path / "b.yml").write_text(rule.format(2))
    assert folder.refresh() and sorted(r["id"] for r in folder.rules) == ["1", "2"] and folder.errors.isEmpty()
