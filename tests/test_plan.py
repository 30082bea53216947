"""The whole batch path on a small attack, and what it writes."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vigilog.operators.forest import train_baseline
from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.plans.detect import detect
from vigilog.sources.catalog import RULES
from vigilog.sources.events import read_events, recent_events, write_events
from vigilog.sources.sinks import write_alert_log, write_stix_bundles

LINES = [
    (0, "CEF:0|Snort|IDS|2.9|1|Port Scan|8|src=203.0.113.9 dst=10.0.0.1"),
    (10, "<34>1 {t} web sshd 1 - - Failed password for root from 203.0.113.9 port 22"),
    (20, "<34>1 {t} web sshd 1 - - Failed password for root from 203.0.113.9 port 22"),
    (30, "<34>1 {t} web sshd 1 - - Accepted password for root from 203.0.113.9 port 22"),
    (40, "<86>1 {t} web sudo 2 - - sudo: root from 203.0.113.9 COMMAND=/bin/bash as root uid=0"),
    (50, "<14>1 {t} web cron 3 - - nothing of note"),
]


def lines(spark):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i, (seconds, text) in enumerate(LINES):
        at = start + dt.timedelta(seconds=seconds)
        rows.append((f"e{i}", text.format(t=at.isoformat() + "Z"), at))
    return spark.createDataFrame(rows, "event_id string, raw string, ingested_at timestamp")


def test_detect_and_sinks(spark, tmp_path):
    model = train_baseline(normalize(parse_logs(lines(spark))), n_trees=10)
    found = detect(lines(spark), model=model)
    chains = {r.chain_id: r for r in found.alerts.where("alert_type = 'correlation'").collect()}
    assert set(chains) == {"chain-001", "chain-002", "chain-003", "chain-005"}
    assert [s.step for s in chains["chain-005"].chain_steps] == [
        "recon", "brute_force", "initial_access", "escalation"]
    assert [s.event_id for s in chains["chain-005"].chain_steps] == ["e0", "e1", "e3", "e4"]
    assert chains["chain-005"].duration_seconds == 40.0
    brute = found.alerts.where("title = 'SSH Brute Force Attempt'").collect()
    assert [(r.hit_count, r.event_id, r.source_key) for r in brute] == [(2, "e1", "203.0.113.9")]
    events = {r.event_id: r for r in found.events.collect()}
    assert len(events) == len(LINES)
    assert "correlated:chain-005" in events["e4"].tags and events["e1"].alert_id == brute[0].alert_id

    write_alert_log(found.alerts, str(tmp_path / "log"))
    write_stix_bundles(found.alerts, str(tmp_path / "stix"))
    n = found.alerts.count()
    assert spark.read.json(str(tmp_path / "log")).where("alert_date = '2024-01-01'").count() == n
    bundles = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "stix")).collect()]
    assert len(bundles) == n
    for b in bundles:
        assert [o["type"] for o in b["objects"]] == ["indicator", "sighting", "observed-data"]
        assert b["objects"][1]["sighting_of_ref"] == b["objects"][0]["id"]

    write_events(found.events, str(tmp_path / "events"))
    stored = read_events(spark, str(tmp_path / "events"))
    newest = recent_events(stored, limit=1).collect()[0]
    assert newest.event_id == "e5" and json.loads(newest.payload)["message"] == "nothing of note"


def test_severity_minimum(spark):
    found = detect(lines(spark), RULES, minimum="critical")
    assert {r.severity for r in found.alerts.select("severity").distinct().collect()} == {"critical"}
    assert found.alerts.agg(F.min("hit_count")).first()[0] == 1
