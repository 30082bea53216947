"""State by buckets of keys: the folds of whole tables against plain versions, and what a stream holds."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from test_stream import events, streamed
from vigilog.plans.detect import find_chains
from vigilog.streaming.detect import stream_alerts, stream_sequences
from vigilog.streaming.ordered import BUCKETS, AlertProcessor, ChainFold, fold_chains, fold_slots, merged_slots

ROW = {"source_key": pa.string(), "us": pa.int64(), "event_id": pa.string()}
FIRED = pa.schema([("source_key", pa.string()), ("chain", pa.int64()), ("us", pa.int64())])


def plain_fires(spec, cap, lock, rows):
    folds, out = {}, []
    for source, us, event_id, *masks in sorted(rows, key=lambda r: r[1:3]):
        fold = folds.setdefault(source, ChainFold(spec, cap, lock))
        out += [(f[0], source, *f[1:4], tuple(f[4])) for f in fold.add(us, event_id, masks)]
    return out


def test_fires_equal_those_row_by_row():
    """Several micro-batches, equal times, a source without a name, few rows remembered."""
    rng = random.Random(9)
    schema = pa.schema([*ROW.items(), *[(f"m{c}", pa.int64()) for c in range(3)]])
    for cap, lock, span in ((500, 40, 3000), (6, 25, 400), (500, 0, 300), (3, 10**6, 900)):
        spec = [("one", 50, 1), ("two", 30, 2), ("four", 200, 4)]
        rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(span), f"{i:04d}", rng.randrange(2), rng.randrange(4),
                 rng.choice([0, 1, 2, 4, 8, 6])) for i in range(700)]
        past, fired, got = schema.empty_table(), FIRED.empty_table(), []
        for low in range(0, span, span // 7):
            part = [r for r in rows if low <= r[1] < low + span // 7]
            rng.shuffle(part)
            fresh = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in part], schema)
            past, fired, fires = fold_chains(spec, cap, lock, past, fresh, fired)
            assert max((past["source_key"].to_pylist().count(s) for s in "abc")) <= cap
            got += [(f.chain_id, f.source_key, f.us, f.event_id, f.first_us, tuple(f.step_events)) for f in fires.itertuples()]
        want = plain_fires(spec, cap, lock, rows)
        assert len(got) == len(want) > 5 and set(got) == set(want)


def test_a_lockout_is_remembered_where_no_row_is_left(spark, tmp_path):
    schema = pa.schema([*ROW.items(), ("m0", pa.int64())])
    fired = pa.table({"source_key": ["a", None], "chain": [0, 0], "us": [5, 6]}, schema=FIRED)
    for held in (fired, FIRED.empty_table()):
        past, kept, fires = fold_chains([("one", 50, 1)], 500, 10, schema.empty_table(), schema.empty_table(), held)
        assert not past.num_rows and kept.sort_by("us") == held and not len(fires)
    chain = {"id": "c", "title": "c", "window_seconds": 10, "steps": [("one", ["Failed password"])]}
    df = events(spark).where("source_key = '10.0.0.1' and event_id < 450").withColumn("event_id", F.when(
        F.col("event_id") < 225, F.col("event_id")).otherwise(F.format_string("%05d", F.col("event_id").cast("int") + 225)))
    got = streamed(spark, df, tmp_path, lambda s: stream_sequences(s, [chain], lock_seconds=700)).collect()
    want = find_chains(df, [chain], lock_seconds=700).collect()
    assert {(r.us, r.event_id) for r in got} == {(r.us, r.event_id) for r in want} and len(got) == len(want) > 3


def test_slots_fold_as_hits_would():
    rng = random.Random(3)
    hits = [(rng.choice(["a", "b", None]), rng.randrange(3000), f"{i:04d}") for i in range(500)]
    names = AlertProcessor(1).tables["slots"]
    for gap in (3, 10, 40):
        now = pa.schema(AlertProcessor(1).tables["open"].items()).empty_table()
        waiting, first, closed = pa.schema(names.items()).empty_table(), [], []
        for low in range(0, 4000, 500):
            fresh = [dict(zip(names, (k, us // gap, 1, us, us, e, e))) for k, us, e in hits if low <= us < low + 500]
            waiting = merged_slots(pa.concat_tables([waiting, pa.Table.from_pylist(fresh, waiting.schema)]))
            ready = pa.array([(s + 1) * gap <= low + 300 for s in waiting["slot"].to_pylist()], pa.bool_())
            rest = waiting.filter(pa.compute.invert(ready))
            a, b, now, ends = fold_slots(now, waiting.filter(ready), rest, gap, low + 300)
            waiting = rest
            assert all(e > low + 300 for e in ends)
            first += a.to_pylist()
            closed += b.to_pylist()
        want = []
        for key in ("a", "b", None):
            for us, e in sorted(h[1:] for h in hits if h[0] == key):
                if want and want[-1][0] == key and us - want[-1][3] < gap:
                    want[-1][1:4:2] = want[-1][1] + 1, us
                else:
                    want.append([key, 1, us, us, e])
        assert sorted(map(repr, closed)) == sorted(repr(dict(zip(now.column_names, w))) for w in want) and not now.num_rows
        assert sorted(r["row"] for r in first) == sorted(w[4] for w in want)


def test_state_grows_by_buckets_not_by_keys(spark, tmp_path):
    """Each key had a state, a timer and calls of its own: 3,000 keys, as many rows of state."""
    df = spark.range(6000).select(
        F.format_string("%05d", "id").alias("event_id"), ((F.col("id") + 1000) * 7_000_000).alias("us"),
        F.concat(F.lit("k"), F.col("id") % 3000).alias("fingerprint")).withColumn("timestamp", F.timestamp_micros("us"))
    got = streamed(spark, df, tmp_path, lambda s: stream_alerts(s, 30), parts=2, part=F.floor(F.col("event_id").cast("int") / 3000))
    assert got.where("status = 'closed'").count() == 6000
    assert max(p.stateOperators[0].numRowsTotal for p in streamed.progress if p.stateOperators) <= 2 * BUCKETS
