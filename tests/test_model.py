import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.functions.net import is_ip, is_private, is_rfc1918
from vigilog.functions.features import features
from vigilog.operators.forest import (
    exact_quantiles, load_model, save_model, score, train_baseline,
)
from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.values import FEATURE_NAMES


@pytest.fixture(scope="module")
def events(spark):
    lines = [(i, f"<38>1 2026-06-0{i % 5 + 1}T{9 + i % 8:02d}:{i % 60:02d}:00Z web sshd {i} - - session {i % 9} opened for u{i % 3}")
             for i in range(600)]
    lines += [(1000 + i, f"<40>1 2026-06-07T03:00:00Z x zz - - - denied error 203.0.113.{i} /etc/passwd port 4444")
              for i in range(3)]
    df = spark.createDataFrame(lines, "event_id int, raw string").withColumn(
        "ingested_at", F.lit("2026-06-01").cast("timestamp"))
    return normalize(parse_logs(df))


def test_features_stay_in_range(spark, events):
    empty = events.limit(1).select(*[
        F.lit(None).cast(t).alias(n) if n != "event_id" else F.lit("none").alias(n) for n, t in events.dtypes])
    for row in features(events.unionByName(empty), keep=["event_id"]).collect():
        values = [row[n] for n in FEATURE_NAMES]
        assert len(values) == 31 and all(0 <= v <= 1 for v in values)


def test_outliers_rank_first_and_training_is_repeatable(spark, events, tmp_path):
    model = train_baseline(events.where("cast(event_id as int) < 1000"), n_trees=60)
    rows = {r.event_id: r for r in score(events, model).collect()}
    ranked = sorted(rows.values(), key=lambda r: -r.anomaly_score)
    # scores end at 1, which the most unusual training events reach as well
    assert all(rows[i].anomaly_score == 1.0 for i in ("1000", "1001", "1002"))
    assert sum(r.anomaly_score for r in ranked[3:]) / len(ranked[3:]) < 0.6
    assert all(0 <= r.anomaly_score <= 1 for r in ranked)
    assert ranked[0].is_anomalous and "ml:anomalous" in ranked[0].tags and len(ranked[0].top_features) == 5
    again = train_baseline(events.where("cast(event_id as int) < 1000").repartition(7), n_trees=60)
    assert sorted(map(tuple, again.trees.collect())) == sorted(map(tuple, model.trees.collect()))
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert {r.event_id: r.anomaly_score for r in score(events, loaded).collect()} == {
        k: r.anomaly_score for k, r in rows.items()}


def test_exact_quantiles(spark):
    values = np.random.default_rng(3).exponential(size=2000).round(2).tolist() + [0.5] * 900
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.01, 0.5, 0.99])
    assert np.allclose(got, np.percentile(values, [1, 50, 99]))


@pytest.mark.parametrize("ip, valid, private, rfc", [
    ("10.0.0.1", True, True, True), ("172.16.0.1", True, True, True), ("172.32.0.1", True, False, False),
    ("192.168.1.1", True, True, True), ("127.0.0.1", True, True, False), ("169.254.1.1", True, True, False),
    ("203.0.113.5", True, False, False), ("::1", True, True, False), ("fc00::1", True, True, False),
    ("2001:db8::1", True, False, False), ("10.0.0.256", False, False, True), ("host", False, False, False),
    ("", False, False, False)])
def test_addresses(spark, ip, valid, private, rfc):
    c = F.lit(ip)
    assert tuple(spark.range(1).select(is_ip(c), is_private(c), is_rfc1918(c)).first()) == (valid, private, rfc)
