"""Small cases whose results follow from the rules."""

import pytest
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions import accessibility, geometry, text, timefmt
from tidemark.operators import audit, bursts, cursor, dataset, dedupe, labeling, models, sanitize, tasks, temporal
from tidemark.schemas import DETAILS, MONITOR, PRESETS

US = 1_000_000
EVENT = "session_id long, category string, ts long, event_id long, monitor_index int"
TOTALS = {c: t for c, (_, t) in PRESETS["accurate"].items()}


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(column.alias("v")).first().v


def made(spark, category, rows):
    events = spark.createDataFrame([(1, category, int(t * US), i, m) for i, (t, m) in enumerate(rows)], EVENT)
    out = bursts.boundaries(events, PRESETS["accurate"][category][0], TOTALS).orderBy("ts").collect()
    return [(r.ts / US, f"{r.request_state}_{r.reason}") for r in out], {r.burst_id for r in out}


def test_gaps(spark):
    out, ids = made(spark, "key", [(100.0, 0), (100.25, 0), (100.5, 0), (102.0, 0)])
    assert sorted(out) == [(100.0, "start_stale"), (100.5, "end_stale"), (102.0, "end_stale"), (102.0, "start_stale")] and ids == {1, 2}


def test_splits(spark):
    out, ids = made(spark, "move", [(200 + i / 4, 0) for i in range(21)])
    assert out == [(200.0, "start_stale"), (202.0, "mid_max_length_exceeded"), (205.0, "end_stale")] and ids == {1}


def test_monitors(spark):
    out, _ = made(spark, "click", [(300.0, 0), (300.125, 1), (300.25, 1), (300.3125, 0), (300.375, 0)])
    assert sorted(out) == sorted([(300.0, "start_stale"), (300.125, "mid_monitor_switch"), (300.3125, "mid_monitor_switch"), (300.125, "mid_max_length_exceeded"), (300.375, "end_stale")])


def test_frames_around_a_burst(spark):
    frames = spark.createDataFrame([(1, t, str(t)) for t in (99900, 99950, 100000, 100600, 101000)], "s int, f long, p string")
    starts = spark.createDataFrame([(1, 100000 - 75)], "s int, t long")
    assert temporal.asof(starts, frames, ["s"], "t", "f", ["p"]).first().p == "99900"
    ends = spark.createDataFrame([(1, 100500 + 75, 102000)], "s int, low long, high long")
    assert temporal.newest_within(ends, frames, ["s"], "low", "high", "f", ["p"]).first().p == "101000"


def test_frames_of_the_same_monitor_come_first(spark):
    frames = spark.createDataFrame([(1, 10, 0, "a"), (1, 12, 1, "b"), (1, 12, 1, "c")], "s int, f long, m int, p string")
    probes = spark.createDataFrame([(1, 9, 1), (1, 9, 2), (1, 12, 1), (1, 13, 1)], "s int, t long, m int")
    out = temporal.asof_preferring(probes, frames, ["s"], "m", "t", "f", ["p"], tie="f").collect()
    assert sorted((r.t, r.m, r.p in ("b", "c") if r.p != "a" else "a") for r in out if r.p) == [(9, 1, True), (9, 2, "a"), (12, 1, True)]
    assert [r.p for r in out if r.t == 13] == [None]


def test_intervals(spark):
    records = spark.createDataFrame([(1, 10, "a", None, "A"), (1, 20, "b", 30, "B"), (1, 25, None, None, "C")], "s int, f int, p string, e int, n string")
    events = spark.createDataFrame([(1, t) for t in (10, 11, 20, 25, 29, 31)], "s int, t int")
    good = sanitize.valid(records, "f", "p")

    def given(end, left_open=True):
        rows = good.withColumn("e", F.when(F.col("n") == "B", F.lit(end)))
        spans = sanitize.linked(rows, events, "s", "f", "e", ["n"], "t")
        out = temporal.assign_intervals(events, spans, ["s"], "t", "start", "end", ["n"], left_open)
        return sorted((r.n, r.t) for r in out.collect())

    assert given(30) == [("A", 11), ("A", 20), ("B", 25), ("B", 29)]
    assert given(None) == [("A", 11), ("A", 20), ("B", 25), ("B", 29), ("B", 31)]
    assert given(30, left_open=False) == [("A", 10), ("A", 11), ("B", 20), ("B", 25), ("B", 29)]
    c = sanitize.counts(records, events, "s", "f", "p", "e", ["n"], "t", "n").first()
    assert (c.n_records, c.n_valid, c.n_events, c.n_assigned, c.n_outside) == (3, 2, 6, 4, 1)


def test_frames_that_change(spark):
    frames = spark.createDataFrame([(1, i, h) for i, h in enumerate([0, 1, 3, None, 3, 2])] + [(2, 0, -1), (2, 1, 0)], "s int, i int, h long")
    out = dedupe.keep_changed(frames, ["s"], ["i"], "h", 1)
    assert sorted((r.s, r.i) for r in out.collect()) == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1)]
    assert out.schema == frames.schema
    again = dedupe.keep_changed(out.where("s = 1"), ["s"], ["i"], "h", 1)
    assert again.count() == 4


def test_prompt(spark):
    monitor = (0, 0, 1000, 500)
    rows = [("key_press", "a", None, None, (100.0, 50.0)), ("key_press", "b", None, None, (100.0, 50.0)), ("mouse_move", None, None, None, (100.0, 50.0)), ("mouse_scroll", None, -1, None, (100.0, 50.0)), ("mouse_move", None, None, None, (200.0, 100.0)), ("mouse_down", None, None, "Button.left", (200.0, 100.0))]
    data = [(1, i, kind, (None, None, 0, dy, button, key, None, None, None), list(at), monitor) for i, (kind, key, dy, button, at) in enumerate(rows)]
    events = spark.createDataFrame(data, f"g int, i int, event_type string, details {DETAILS}, cursor_position array<double>, monitor {MONITOR}")
    prompt = labeling.prompts(events, ["g"], ["i"], F.lit("00:07")).first().prompt
    assert prompt == "\n    00:07 Event:\n    Cursor positions: (100, 100) to (200, 200)\n    Actions:\n    \tKeys pressed: a|b\n\tScrolled down\n\tMouse moved from (100, 100) to (200, 200)\n\tMouse clicked left at (200, 200)\n        "
    assert value(spark, text.actions(F.lit(prompt))).split("\n") == ["\u2022 " + a for a in ("Keys pressed: a|b", "Scrolled down", "Mouse moved from (100, 100) to (200, 200)", "Mouse clicked left at (200, 200)")]
    quiet = labeling.prompts(events.limit(1).withColumn("event_type", F.lit("mouse_up")), ["g"], ["i"], F.lit("00:07")).first().prompt
    assert "Cursor position: (100, 100)\n" in quiet and "No actions recorded." in quiet


def test_caption_ranges(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5)], "s int, t int")
    caps = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "s int, start_seconds int, end_seconds int")
    out = labeling.match_captions(caps, rows, "s", ["t"], ["start_seconds"]).orderBy("start_seconds").collect()
    assert [(r.start_index, r.end_index, r.n_rows) for r in out] == [(0, 1, 2), (1, 4, 4)]
    far = labeling.match_captions(spark.createDataFrame([(1, 9, 9)], caps.schema), rows, "s", ["t"], ["start_seconds"], attach_tail=False).first()
    assert (far.start_index, far.end_index) == (4, 4)


def test_segments_of_frames(spark):
    rows = lambda ts: spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "s int, i int, t double")
    got = lambda ts: [r.segment for r in temporal.split_frames(rows(ts), ["s"], "i", "t", 300).orderBy("i").collect()]
    assert got([100.0, 200.0, 500.0, 800.5]) == [1, 1, 1, 2]
    assert got([100.0, None, 500.0, 700.0]) == [1, 1, 2, 2]
    assert got([None, 100.0, 900.0]) == [1, 1, 1]


def test_splits_of_datasets(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "s int, i int, t double")
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(dataset.split_by_ratio(rows, ["s"], ["i"], [0.5, 0.25, 0.25])) == {"train": 5, "test": 2, "validation": 3}
    assert count(dataset.split_by_time(rows, ["s"], ["i"], F.col("t"), [3, 2, 1])) == {"train": 3, "test": 2, "validation": 5}
    with pytest.raises(ValueError):
        dataset.split_by_ratio(rows, ["s"], ["i"], [0.5, 0.5, 0.5])
    assert dataset.format_of(["img", "raw_events"]) == 1 and dataset.format_of(["start", "chunk_index"]) == 2
    with pytest.raises(ValueError):
        dataset.format_of(["x"])


def test_names_and_clocks(spark):
    name = F.lit("a/b/1760702571.228687_reason_move_start.jpg")
    assert value(spark, timefmt.frame_time(name)) == 1760702571.228687
    assert (value(spark, timefmt.frame_reason(name)), value(spark, timefmt.frame_category(name))) == ("move_start", "move")
    assert value(spark, timefmt.frame_time(F.lit("x_20240102030405678.png"))) == 1704164645.678
    assert value(spark, timefmt.frame_time(F.lit("x.png"), F.lit(7.0))) == 7.0
    assert value(spark, timefmt.listing_time(F.lit("20240102030405.png"))) == 1704164645.0
    assert [value(spark, timefmt.prefix_time(F.lit(p))) for p in ("d/12.5_x.jpg", "d/x.jpg")] == [12.5, 0.0]
    assert value(spark, timefmt.clock(F.lit(3725))) == "62:05" and value(spark, timefmt.clock_seconds(F.lit("62:05"))) == 3725
    assert value(spark, timefmt.unstamp(timefmt.stamp(F.lit(1700000000.25)))) == 1700000000.25
    assert value(spark, timefmt.stamp(F.lit(1700000000.25))) == "2023-11-14_22-13-20-250000"
    assert [timefmt.duration(x) for x in ("2wk", " 14D", "48hr")] == [1209600, 1209600, 172800]
    assert [timefmt.duration_text(x) for x in (1209600, 86400, 90000)] == ["2wk", "1d", "25hr"]
    assert timefmt.split_spec("1wk,1d,1hr") == [604800, 86400, 3600] and timefmt.split_spec("0.5, 0.25,0.25") == [0.5, 0.25, 0.25]
    for bad in ("1,2", "0.5,0.5,0.5", "1wk,2x,3d"):
        with pytest.raises(ValueError):
            timefmt.split_spec(bad)
    with pytest.raises(ValueError):
        timefmt.duration("5m")


def test_parsed_captions(spark):
    answer = '[{"start":"00:05","end":"00:07","caption":"a"},{"start":"bad","end":"00:02","description":"b"},{"start":"00:03","end":"bad"}]'
    rows = spark.createDataFrame([(1, 60, answer), (2, 60, '{"a": 1}'), (3, 60, "nothing"), (4, 60, None)], "id int, at int, answer string")
    out = labeling.parsed_captions(rows, "answer", "at", ["id"]).orderBy("position").collect()
    assert [(r.id, r.start_seconds, r.end_seconds, r.caption) for r in out] == [(1, 65, 67, "a"), (1, 60, 62, "b"), (1, 63, 63, "")]


def test_reconciled_keys(spark):
    events = spark.createDataFrame([(t,) for t in (1, 2, 3)], "t int")
    caught = spark.createDataFrame([(t,) for t in (1, 2, 2)], "t int")
    assert {r.t: r.status for r in audit.reconcile(events, caught, ["t"]).collect()} == {1: "unique", 2: "duplicate", 3: "unmatched"}
    assert [r.t for r in audit.orphans(events, caught, ["t"]).collect()] == [3]


def test_category_intervals(spark):
    rows = [("start", 1), ("start", 2), ("mid", 3), ("end", 4), ("end", 5), ("start", 6)]
    requests = spark.createDataFrame([(1, "key", t, s, t) for s, t in rows], "session_id int, category string, ts int, request_state string, event_id int")
    assert [(r.start_ts, r.end_ts) for r in audit.category_intervals(requests).collect()] == [(2, 4)]


def test_merging(spark):
    rows = [(1, 1, "a/5.0_x.jpg", 0.5), (1, 2, None, 0.5), (1, 3, "a/5.0_y.jpg", 0.5), (1, 4, "a/6.0_x.jpg", 0.5), (1, 5, "a/x_y.jpg", 0.5), (2, 1, None, 0.5), (2, 2, "a/6.0_x.jpg", 0.5), (2, 3, "a/7.0_x.jpg", 0.5)]
    df = spark.createDataFrame(rows, "s int, t int, screenshot_path string, scale_factor double").withColumn("end", F.col("t"))
    out = labeling.merged(df, ["s"], ["t"], ["t", "screenshot_path"], ["end"]).orderBy("s", "t").collect()
    assert [(r.s, r.t, r.end, r.screenshot_path, r.num_merged, r.scale_factor) for r in out] == [(1, 1, 3, "a/5.0_x.jpg", 3, 1.0), (1, 4, 4, "a/6.0_x.jpg", 1, 0.5), (1, 5, 5, "a/x_y.jpg", 1, 0.5), (2, 1, 3, None, 3, 1.0)]


def test_geometry(spark):
    monitor = F.struct(F.lit(100).alias("left"), F.lit(0).alias("top"), F.lit(200).alias("width"), F.lit(100).alias("height"))
    assert value(spark, geometry.per_mille(F.array(F.lit(100.5), F.lit(0.25)), monitor)) == "(2, 2)"  # 2.5 to even
    assert value(spark, geometry.per_mille(F.array(F.lit(1.0)), monitor)) is None
    assert value(spark, geometry.per_mille(F.array(F.lit(1.0), F.lit(2.0)), F.lit(None).cast(MONITOR))) == "(1.0, 2.0)"
    assert [value(spark, geometry.inside(F.lit(x), F.lit(0), monitor)) for x in (99, 100, 299, 300)] == [False, True, True, False]
    two = F.array(monitor.cast(MONITOR), F.struct(F.lit(0), F.lit(0), F.lit(100), F.lit(100)).cast(MONITOR))
    assert [value(spark, geometry.monitor_at(F.lit(x), F.lit(5), two)) for x in (150, 50, 999)] == [0, 1, 0]
    assert [value(spark, c) for c in geometry.shrunk(F.lit(4000), F.lit(1000), (1920, 1080))] == [1920, 480]
    assert [value(spark, c) for c in geometry.shrunk(F.lit(1000), F.lit(4000), (1920, 1080))] == [480, 1920]
    assert [value(spark, c) for c in geometry.shrunk(F.lit(10), F.lit(5), (1920, 1080))] == [10, 5]
    assert [value(spark, c) for c in geometry.to_image(F.lit(98.3), F.lit(5.9), monitor, F.lit(1.0))] == [-1, 5]
    assert [value(spark, c) for c in geometry.fitted(F.lit(100), F.lit(50), F.lit(30), F.lit(30))] == [30, 15]
    assert value(spark, geometry.dpi(F.lit(1000), F.lit(254.0))) == 100.0


def test_texts(spark):
    kinds = ["mouse_down", "mouse_up", "mouse_drag", "mouse_scroll", "hotkey", "scrolled", "other", "", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, k string")
    assert [r.c for r in rows.select("i", text.coarse(F.col("k")).alias("c")).orderBy("i").collect()] == ["click", "click", "move", "scroll", "key", "scroll", "other", "unknown", "unknown"]
    assert value(spark, text.sql_quoted(F.lit("a\\b'\n\r"))) == "a\\\\b\\'\\n\\r"
    assert value(spark, text.salvaged_json(F.lit('Sure: [{"a": 1}] done'))) == '[{"a": 1}]'
    assert value(spark, text.salvaged_json(F.lit("none"))) == "none"
    assert value(spark, text.unsigned_to_signed(F.lit("18446744073709551615").cast("decimal(20,0)"))) == -1
    assert value(spark, text.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    assert [value(spark, text.hash_key(F.lit(p))) for p in ("a/b/c/d.jpg", "c/d.jpg")] == ["b/c/d.jpg", "c/d.jpg"]
    assert value(spark, text.frame_name(F.lit(1.5), F.lit("key_start"))) == "1.500000_reason_key_start.jpg"
    assert value(spark, text.data_url(F.lit(b"hi"), F.lit("video/mp4"))) == "data:video/mp4;base64,aGk="
    assert [value(spark, text.button_colour(F.lit(b))) for b in ("Button.left", "x")] == ["red", "yellow"]
    assert value(spark, text.filled("<{{LOGS}}>", F.lit("x"))) == "<x>"


def test_model_calls_resume(spark):
    chunks = spark.createDataFrame([(1, 0, "a prompt"), (1, 1, "FAIL"), (2, 0, "more")], "session_id int, chunk_index int, prompt string")
    out = models.answers(chunks, models.FixedClient, parallel=2)
    assert sorted((r.chunk_index, r.answer is None, r.error) for r in out.collect()) == [(0, False, None), (0, False, None), (1, True, "the model gave no answer")]
    done = models.resumed(out.limit(0), out)
    assert models.pending(chunks, done, ["session_id", "chunk_index"]).count() == 1
    assert isinstance(models.client("fixed"), models.Client)
    with pytest.raises(ValueError):
        models.client("other")


def test_tasks(spark):
    rows = tasks.numbered(spark.createDataFrame([(1, t, c) for t, c in enumerate("abcd")], "s int, t int, caption string"), ["s"], ["t"])
    seg = spark.createDataFrame([(1, 0, ["x", "y"]), (1, 1, ["y"]), (1, 9, ["z"])], "s int, event_no int, task_ids array<string>")
    found = tasks.grouped(seg, rows, ["s"])
    assert sorted((r.task_id, r.caption) for r in found.collect()) == [("x", "a"), ("y", "a"), ("y", "b")]
    chosen = spark.createDataFrame([("y", 1)], "task_id string, event_no int")
    assert [r.caption for r in tasks.only_chosen(found, chosen, ["task_id", "event_no"]).collect()] == ["b"]
    assert sorted(r.caption for r in tasks.noise(rows, found, ["s", "event_no"]).collect()) == ["c", "d"]


def test_elements(spark):
    cases = [("{}", False), ('{"AXTitle": " "}', False), ('{"AXTitle": "x"}', True), ('{"AXRole": "AXImage", "_parent": {"AXTitle": "p"}}', False), ('{"AXRole": "AXButton"}', True), ('{"AXRole": "Odd", "_parent": {"AXTitle": "p"}}', True), ('{"AXRole": "Odd"}', False), (None, False)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, e string")
    assert [r.u for r in rows.select("i", accessibility.useful(F.col("e")).alias("u")).orderBy("i").collect()] == [u for _, u in cases]
    kept = value(spark, accessibility.projected(F.lit('{"AXRole": "AXLink", "AXURL": "u", "AXValue": "v", "AXTitle": "", "_parent": {"AXRole": "r", "AXValue": "no"}}')))
    assert kept == '{"AXRole":"AXLink","AXURL":"u","_parent":"{\\"AXRole\\":\\"r\\"}"}'
    assert value(spark, accessibility.projected(F.lit('{"Other": 1}'))) is None
    events = spark.createDataFrame([(1, i, "mouse_move" if i < 20 else k) for i, k in enumerate(["m"] * 20 + ["mouse_up", "key_press"])], "s int, i int, event_type string")
    assert [r.i for r in accessibility.sampled(events, ["s"], ["i"]).where("looked_up").orderBy("i").collect()] == [9, 19, 21]


def test_cursor_paths(spark):
    one, two, three = (dict(left=i * 100, top=0, width=100, height=100) for i in range(3))
    at = lambda x, m: dict(cursor_position=[float(x), 5.0], monitor=m)
    frames = [(1, 0, [at(10, one), at(20, one), at(150, two), at(160, two), at(250, three)], one), (1, 1, [at(170, two)], two), (1, 2, [], two), (2, 0, None, None)]
    df = spark.createDataFrame(frames, f"s int, i int, events array<struct<cursor_position:array<double>,monitor:{MONITOR}>>, monitor {MONITOR}")
    out = {(r.s, r.i): [e.cursor_position[0] for e in r.events] for r in cursor.carried(df, ["s"], ["i"]).collect()}
    assert out == {(1, 0): [10, 20, 150, 160, 250], (1, 1): [150, 160, 170], (1, 2): [], (2, 0): []}
    flat = df.select("s", "i", F.col("monitor").alias("frame_monitor"), F.posexplode("events").alias("n", "e")).select("s", "i", "frame_monitor", "n", "e.cursor_position")
    assert [(r.start[0], r.end[0]) for r in cursor.movements(flat, ["s", "i"], ["n"]).collect()] == [(10.0, 20.0)]
    sizes = spark.createDataFrame([(10, 40), (30, 20)], "width int, height int")
    assert tuple(cursor.largest(sizes).first()) == (30, 40) and tuple(cursor.largest(sizes.limit(0)).first()) == (1920, 1080)


def test_presets(monkeypatch):
    assert settings.preset().gaps["click"] == 200_000 and settings.preset("rough").longest == 24 * US
    monkeypatch.setenv("CAPTURE_PRECISION", "rough")
    assert settings.preset().gaps["key"] == 2 * US
    with pytest.raises(ValueError):
        settings.preset("other")


def test_model_entries(spark):
    class Cleaner(models.Client):
        def upload(self, path, session_id=None):
            return None

        def generate(self, prompt, file=None, schema=None):
            return '{"entries": [{"id": 1, "clean_caption": "clean", "event_id": 1, "task_ids": ["x"]}]}'

    rows = spark.createDataFrame([(1, "t")], "s int, transcript string")
    assert [tuple(r) for r in models.clean_captions(rows, Cleaner, ["s"]).collect()] == [(1, 1, "clean")]
    assert [tuple(r) for r in models.segment_tasks(rows, Cleaner, ["s"]).collect()] == [(1, 1, ["x"])]
