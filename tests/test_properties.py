"""Properties of the folds, over many small inputs, and of the joins, over one large random one."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import bursts, dataset, dedupe, sanitize, temporal
from tidemark.operators.cursor import leaving

steps = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=1, max_size=40)


@settings(max_examples=200, deadline=None)
@given(steps, st.integers(1, 12))
def test_splits_keep_the_rules(rows, total):
    """Every split is at an event of the open part; what stays open is a suffix of the events."""
    burst, seen, ts = bursts.OpenBurst(total), [], 0
    for i, (step, monitor) in enumerate(rows):
        ts += step
        before = list(burst.queue)
        out = burst.push(ts, monitor, i)
        seen.append((ts, monitor, i))
        assert burst.queue == seen[-len(burst.queue) :]
        if out and out[0] == bursts.SWITCH:
            assert monitor != before[-1][1] and out[1:] == seen[-1] and len(burst.queue) == len(before) + 1
        elif out:
            assert ts - before[0][0] > total and out[1:] in before
            middle = before[0][0] + before[-1][0]
            assert all(abs(2 * out[1] - middle) <= abs(2 * b[0] - middle) for b in before)
        else:
            assert not before or (monitor == before[-1][1] and ts - before[0][0] <= total)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 2)), max_size=12))
def test_what_leaves_a_monitor(places):
    monitors = [dict(left=i * 100, top=0, width=100, height=10) for i in range(3)]
    events = [dict(cursor_position=[x, 5], monitor=monitors[m]) for x, m in places]
    out = leaving(events, monitors[0])
    assert all(e["cursor_position"][0] >= 100 for e in out) and len({e["monitor"]["left"] for e in out}) <= 1
    assert all(e in events[1:] for e in out)


def random_events(spark, n=3000, sessions=5):
    rng = random.Random(12)
    rows = [(rng.randrange(sessions), rng.choice(["key", "move"]), rng.randrange(200_000), i, rng.randrange(3), rng.choice([None, *range(8)])) for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, category string, ts long, event_id long, monitor_index int, hash long")


def test_joins_and_splits_over_random_rows(spark):
    events = random_events(spark)
    frames = random_events(spark, 400).select("session_id", F.col("ts").alias("f"), F.col("event_id").alias("frame_id"))
    spans = sanitize.linked(frames.withColumn("own_end", F.lit(None).cast("long")), events, "session_id", "f", "own_end", ["frame_id"], "ts")
    for left_open in (True, False):
        given_ = temporal.assign_intervals(events, spans, ["session_id"], "ts", "start", "end", ["frame_id"], left_open)
        assert given_.groupBy("event_id").count().where("count > 1").count() == 0
        assert given_.count() <= events.count()
    # every event is in one burst, and bursts of a category don't overlap
    parts = bursts.with_bursts(events, 300)
    assert parts.count() == events.count()
    spread = bursts.with_bursts(events, 300, part=5000)
    assert sorted(map(tuple, spread.select("event_id", "burst_no", "burst_start").collect())) == sorted(map(tuple, parts.select("event_id", "burst_no", "burst_start").collect()))
    near = temporal.asof(events, frames, ["session_id"], "ts", "f", ["frame_id"], tie="frame_id")
    far = temporal.asof_in_parts(events, frames, ["session_id"], "ts", "f", ["frame_id"], 7000, tie="frame_id")
    assert sorted(str((r.event_id, r.frame_id)) for r in near.collect()) == sorted(str((r.event_id, r.frame_id)) for r in far.collect())
    once = dedupe.keep_changed(events, ["session_id"], ["ts", "event_id"], "hash", 1)
    twice = dedupe.keep_changed(once, ["session_id"], ["ts", "event_id"], "hash", 1)
    assert once.count() == twice.count() < events.count()
    split = dataset.split_by_ratio(events, ["session_id"], ["ts", "event_id"], [0.6, 0.2, 0.2])
    assert split.count() == events.count() and {r.split for r in split.select("split").distinct().collect()} == {"train", "test", "validation"}


def test_empty_tables(spark):
    events = random_events(spark).limit(0)
    frames = events.select("session_id", F.col("ts").alias("f"), F.col("event_id").alias("frame_id"))
    assert bursts.boundaries(events, 300, {"key": 1, "move": 1}).collect() == []
    assert temporal.asof(events, frames, ["session_id"], "ts", "f", ["frame_id"]).collect() == []
    assert temporal.asof_in_parts(events, frames, ["session_id"], "ts", "f", ["frame_id"], 10).collect() == []
    assert dedupe.keep_changed(events, ["session_id"], ["ts"], "hash").collect() == []
