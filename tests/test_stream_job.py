"""The streaming jobs of the whole path against the batch path."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vigilog.operators.alerts import alerts
from vigilog.operators.forest import Baseline, score
from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import enrich_with_matches
from vigilog.plans.detect import find_chains
from vigilog.session import checkpointed
from vigilog.sources.catalog import CHAINS, RULES
from vigilog.streaming.job import Detection
from workload.anomaly import HIGH, LOW, MEANS, SAMPLE, TREE_SCHEMA, forest_rows

MESSAGES = ["Failed password for pia from {ip} port 22 ssh2", "Accepted password for pia from {ip} port 22 ssh2",
            "Port Scan Detected from {ip}", "session opened for nobody", "{ip} GET /index.html 200"]


def test_alerts_equal_the_batch(spark, tmp_path):
    rng = random.Random(17)
    start = dt.datetime(2025, 3, 9, 4, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(400):
        at = start + dt.timedelta(seconds=20 * i + rng.randint(0, 9))
        text = rng.choice(MESSAGES).format(ip=f"198.51.100.{rng.randint(1, 3)}")
        rows.append((f"e{i:04d}", f"<34>1 {at:%Y-%m-%dT%H:%M:%S}Z relay-2 sshd 51 - - {text}", at))
    lines = spark.createDataFrame(rows, "event_id string, raw string, ingested_at timestamp")
    model = Baseline(spark.createDataFrame(forest_rows(), TREE_SCHEMA), MEANS, SAMPLE, LOW, HIGH, 1)
    events = checkpointed(enrich_with_matches(normalize(parse_logs(lines, reference_year=2025)), RULES).drop("fired"))
    want = alerts(events, RULES, find_chains(events, CHAINS), score(events, model))

    last = spark.createDataFrame(  # far later, of another source: all others are past
        [("zzz", f"<34>1 {start + dt.timedelta(days=9):%Y-%m-%dT%H:%M:%S}Z relay-9 sshd 51 - - Failed password for pia from 203.0.113.9 port 22 ssh2",
          start + dt.timedelta(days=9))], lines.schema)
    path = str(tmp_path / "lines")
    for k in range(3):
        lines.where(F.floor(F.substring("event_id", 2, 4).cast("int") % 30 / 10) == k).coalesce(1).write.mode("append").parquet(path)
    last.write.mode("append").parquet(path)
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(path)
    folder = str(tmp_path / "job")
    Detection(source, folder, model=model, late="3 hours", reference_year=2025, trigger={"availableNow": True}).run()

    columns = ["alert_id", "alert_type", "title", "severity", "source_key", "event_id", "us", "hit_count", "first_us", "last_us",
               "chain_id", "anomaly_score", "event_message"]
    rows_of = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    got = [r for r in rows_of(spark.read.parquet(f"{folder}/alerts")) if r[5] != "zzz"]
    assert got == rows_of(want) and {r[1] for r in got} == {"sigma", "correlation", "ml"}
    assert spark.read.parquet(f"{folder}/events").count() == 401
