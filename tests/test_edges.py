"""Cases at the edges: long tie keys, values that look empty, unknown monitors, odd folder names."""

import json

from pyspark.sql import functions as F

from tidemark.functions import accessibility, text, timefmt
from tidemark.operators import bursts, cursor, tasks, temporal
from tidemark.sources import sessions, sinks


def test_ties_by_long_keys(spark):
    ids = [f"{'0' * 30}-{x}" for x in ("a1", "b2", "a9")]
    frames = spark.createDataFrame([(1, 5, i) for i in ids], "s long, f long, id string")
    probes = spark.createDataFrame([(1, 7)], "s long, ts long")
    assert temporal.asof(probes, frames, ["s"], "ts", "f", ["id"], tie="id").first().id == ids[1]
    numbers = spark.createDataFrame([(1, 5, n) for n in (9, 10, 2)], "s long, f long, id long")
    assert temporal.asof(probes, numbers, ["s"], "ts", "f", ["id"], tie="id").first().id == 10


def test_texts_of_zero_say_something(spark):
    cases = [({"AXValue": "0"}, True), ({"AXValue": "false"}, True), ({"AXValue": 0}, False), ({"AXValue": False}, False), ({"AXValue": "  "}, False), ({"AXValue": []}, False), ({"AXValue": [1]}, True), ({"AXValue": 0.5}, True), ({"AXValue": None}, False), ({}, False)]
    rows = spark.createDataFrame([(i, json.dumps({"AXRole": "AXStaticText"} | c)) for i, (c, _) in enumerate(cases)], "i int, e string")
    got = {r.i: r for r in rows.select("i", accessibility.useful(F.col("e")).alias("u"), accessibility.projected(F.col("e")).alias("p")).collect()}
    assert [got[i].u for i in range(len(cases))] == [want for _, want in cases]
    assert json.loads(got[0].p) == {"AXRole": "AXStaticText", "AXValue": "0"} and json.loads(got[2].p) == {"AXRole": "AXStaticText"}


def test_unknown_monitors_do_not_stop_a_path():
    monitor, other = dict(left=0, top=0, width=10, height=10), dict(left=10, top=0, width=10, height=10)
    at = lambda x, m: dict(cursor_position=[x, 1], monitor=m)
    events = [at(1, monitor), at(12, None), at(13, other), at(14, other), at(15, None), at(16, other)]
    assert cursor.leaving(events, monitor) == events[1:4]


def test_session_folders_of_odd_names(spark, tmp_path):
    for root in ("rec", "a+b", "c d"):
        for name in ("s1/aggregations.jsonl", "s1/screenshots/1.5_a.jpg", f"s2/{root}/screenshots/9.jpg", "s2/aggregations.jsonl", "s2/screenshots/2.5.jpg"):
            p = tmp_path / root / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("{}")
        assert {r.session_id: r.n_screenshots for r in sessions.discover(spark, str(tmp_path / root)).collect()} == {"s1": 1, "s2": 1}


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}", "a" if i % 2 else "b") for i in range(7)], "s long, ts long, path string, kind string")
    got = temporal.chunk_frames(rows, ["s"], ["ts"], 3, "path", "ts").orderBy("chunk_index").collect()
    assert [(r.n_rows, r.start_ts, r.end_ts, r.paths) for r in got] == [(3, 0, 2, ["p0", "p1", "p2"]), (3, 3, 5, ["p3", "p4", "p5"]), (1, 6, 6, ["p6"])]
    assert sorted(tasks.noise_totals(rows, rows.where("ts < 3"), ["s", "ts"], "kind").collect()) == [("a", 2, 3), ("b", 2, 4)]
    marks = spark.createDataFrame([(1, 1, "start"), (1, 5, "end"), (1, 3, "start"), (1, 9, "end")], "s long, ts long, request_state string")
    assert [temporal.active_bursts(marks, ["s"], now).first().n_active for now in (1, 4, 5, 9)] == [1, 2, 1, 0]
    one = spark.range(1).select(timefmt.num_chunks(F.lit(120.5), 60).alias("n"), text.is_scroll(F.lit("mouse_scroll")).alias("a"), text.is_move(F.lit("mouse_up")).alias("b"))
    assert one.first() == (3, True, False)


def test_boundaries_keep_the_monitor(spark):
    rows = [(1, "key", t, t, m) for t, m in ((0, 1), (1, 1), (2, 2), (3, 2))]
    out = bursts.boundaries(spark.createDataFrame(rows, "session_id long, category string, ts long, event_id long, monitor_index int"), 5, {"key": 100})
    assert sorted((r.ts, r.request_state, r.monitor_index) for r in out.collect()) == [(0, "start", 1), (2, "mid", 2), (3, "end", 2)]


def test_pictures_that_are_kept(spark):
    frames = spark.createDataFrame([(1_500_000, True), (2_500_000, False), (3_500_000, None)], "frame_ts long, wanted boolean")
    for buffer_all, want in ((False, ["1.500000"]), (True, ["1.500000", "2.500000", "3.500000"])):
        out = sinks.chosen_frames(frames, F.col("wanted"), F.lit("key_start"), buffer_all=buffer_all).collect()
        assert sorted(r.path.split("_reason_key_start")[0] for r in out) == want
