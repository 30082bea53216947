"""Headline queries, timed: prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigilog.operators.alerts import alerts_from_matches, merge_alerts
from vigilog.operators.dedup import dedup_gap
from vigilog.operators.forest import score, train_baseline
from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import match_rules
from vigilog.operators.sequence import chain_steps, match_sequences
from vigilog.plans.detect import detect
from vigilog.session import checkpointed, configure, release
from vigilog.sources.catalog import RULES
from workload import base

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def many_rules(n):
    """The shipped rules repeated with words of their own, up to n rules."""
    rules = list(RULES)
    for i in range(n - len(RULES)):
        rules.append(dict(id=f"extra-{i}", title=f"Extra {i}", level="low", tags=[], detection={
            "a": {"message|contains": [f"word{i}", f"term{i}"]}, "b": [f"other{i}"],
            "condition": "a and not b"}))
    return rules


def main():
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    lines = checkpointed(base.log_lines(spark, SF).repartition(int(CPUS)))
    n = lines.count()
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    parsed = lambda: normalize(parse_logs(lines, reference_year=2024))
    events = base.events(spark, SF)
    slim = events.select("source_key", "us", "event_id", "source_ip", "host", "program", "message",
                         "tags", "sigma_matches")
    seconds = {}

    def timed(name, run):
        begin = time.time()
        run()
        seconds[name] = round(time.time() - begin, 3)

    drain(parsed().limit(1000))
    timed("parse_normalize", lambda: drain(parsed()))
    timed("rules_17", lambda: drain(match_rules(events, RULES).select("event_id", "fired")))
    timed("rules_200", lambda: drain(match_rules(events, many_rules(200)).select("event_id", "fired")))
    timed("rules_1000", lambda: drain(match_rules(events, many_rules(1000)).select("event_id", "fired")))
    timed("dedup_gap", lambda: drain(dedup_gap(
        events.select("source_key", "us", "event_id"), ["source_key"], "us", 300, ["event_id"])))
    timed("match_sequences", lambda: drain(match_sequences(
        slim, ["source_key"], "us", ["event_id"], chain_steps(base.LONG_CHAINS),
        lock_seconds=base.LOCK_SECONDS)))
    for steps in (2, 4):  # patterns of so many steps on their own
        some = [(i, w, s[:steps]) for i, w, s in chain_steps(base.LONG_CHAINS) if len(s) >= steps][:1]
        if some:
            timed(f"match_sequence_{steps}", lambda: drain(match_sequences(
                slim, ["source_key"], "us", ["event_id"], some, lock_seconds=base.LOCK_SECONDS)))
    timed("alerts", lambda: drain(merge_alerts(alerts_from_matches(events, RULES))))
    models = []
    timed("train_forest", lambda: models.append(train_baseline(events)))
    timed("score_forest", lambda: drain(score(events, models[0]).select(
        "event_id", "anomaly_score", F.size("top_features"))))
    timed("detect", lambda: drain(detect(lines, model=models[0], reference_year=2024).alerts))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": SF.rstrip("/").split("/")[-1], "events": n,
        "events_per_sec": {k: round(n / v) for k, v in seconds.items()}}))
    release(spark)


if __name__ == "__main__":
    main()
