import json

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import EVENT, SCREENSHOT
from tidemark.sources import logs, sessions, sinks

LINES = [
    '{"timestamp": 1.5, "event_type": "mouse_down", "cursor_position": [1, 2]}',
    "{'timestamp': 2.5, 'event_type': 'key_press', 'details': {'key': None}, 'cursor_position': (1, 2)}",
    "{'timestamp': 3.5, 'event_type': 'odd \\' quote', 'details': {'double_click': True}}",
    "",
    "   ",
    "not a record",
    "[1, 2]",
    "{'broken': ",
    '{"timestamp": 4.5}',
]


def test_lines_of_two_kinds(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text("\n".join(LINES))
    rows = {r.timestamp: r for r in logs.read_events(spark, str(tmp_path / "events.jsonl")).collect()}
    assert sorted(rows) == [1.5, 2.5, 3.5, 4.5]
    assert rows[2.5].details.key is None and rows[2.5].cursor_position == [1.0, 2.0]
    assert rows[3.5].event_type == "odd ' quote" and rows[3.5].details.double_click
    assert [rows[t].coarse_type for t in (1.5, 2.5, 4.5)] == ["click", "key", "unknown"]
    bad = logs.bad_lines(spark.read.text(str(tmp_path / "events.jsonl"))).collect()
    assert sorted(r.value for r in bad) == ["not a record", "{'broken': "]


def test_aggregations_take_the_frame_time(spark, tmp_path):
    lines = [{"timestamp": 1.0, "screenshot_timestamp": 2.0}, {"timestamp": 3.0}, {"timestamp": 4.0, "screenshot_timestamp": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted(str(r.timestamp) for r in logs.read_aggregations(spark, str(tmp_path / "a.jsonl")).collect()) == ["2.0", "3.0", "None"]


def test_hashes(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"entries": {"a/b/c.jpg": {"hash_int": 2**64 - 1}, "d": {"hash_int": 5}}}))
    assert {r.key: r.hash for r in logs.read_hashes(spark, str(tmp_path / "h.json")).collect()} == {"a/b/c.jpg": -1, "d": 5}


def test_sessions_and_pictures(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ("one/screenshots/2.5_a.jpg", "one/screenshots/1.5_a.png", "one/screenshots/none.jpg", "one/aggregations.jsonl", "two/aggregations.jsonl", "three/screenshots/1.5.JPG", "four/9.5.png", "five/screenshots/1.0.jpg", "five/aggregations.jsonl", "five/data.jsonl"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}")
    found = lambda df: {r.session_id: r.n_screenshots for r in df.collect()}
    assert found(sessions.discover(spark, str(root))) == {"one": 3, "five": 1}
    assert found(sessions.discover(spark, str(root), skip_existing=True)) == {"one": 3}
    assert found(sessions.discover_pictures(spark, str(root))) == {"one": 3, "three": 1, "four": 1, "five": 1}
    shots = logs.list_screenshots(spark, str(root / "one" / "screenshots")).orderBy("position").collect()
    assert [(r.position, r.ts) for r in shots] == [(0, 1.5), (1, 2.5)]
    files = logs.listing(spark, str(root))
    rows = spark.createDataFrame([("2.5_a.jpg",), (f"file:{root}/four/9.5.png",), ("gone.jpg",)], "img string")
    out = logs.resolve_pictures(rows, files, "img", F.lit(f"file:{root}/one")).collect()
    assert {r.img.rsplit("/", 1)[-1]: r.resolved and r.resolved.rsplit("/", 1)[-1] for r in out} == {"2.5_a.jpg": "2.5_a.jpg", "9.5.png": "9.5.png", "gone.jpg": None}
    assert sessions.session_paths("a/")["matched"] == "a/data.jsonl"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "session_id string, chunk_index int, caption string")
    sinks.write_chunks(rows, str(tmp_path / "c"))
    sinks.write_chunks(rows.where("chunk_index = 1").withColumn("caption", F.lit("new")), str(tmp_path / "c"))
    assert {r.chunk_index: r.caption for r in spark.read.json(str(tmp_path / "c")).collect()} == {0: "a", 1: "new"}
    for _ in range(2):
        sinks.append_json(rows, str(tmp_path / "j"))
        sinks.write_json(rows, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4 and spark.read.json(str(tmp_path / "w")).count() == 2
    sinks.write_dataset(rows.withColumn("split", F.lit("train")), str(tmp_path / "d"))
    assert (tmp_path / "d" / "split=train").is_dir()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(LINES))
    stream = logs.parse_lines(logs.stream_lines(spark, str(tmp_path / "in")), EVENT)
    sinks.stream_to_json(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.schema(EVENT).json(str(tmp_path / "out")).count() == 4
    seen = []
    sinks.stream_to(logs.stream_events(spark, str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert seen == [8] or sum(seen) >= 2


def test_pictures_are_needed(spark):
    rows = spark.createDataFrame([(None,), ("",)], "img string")
    with pytest.raises(ValueError):
        logs.rows_with_pictures(rows)
    assert "path" in SCREENSHOT


def test_large_hash_cache_is_split(spark, tmp_path):
    """One document of 60,000 entries is read by several tasks; keys with quotes, backslashes and other letters; odd documents are parsed whole."""
    import json

    entries = {f'd/{i}/"q"\\{chr(228 + i % 3)}.jpg': {"hash_int": (i * 0x9E3779B97F4A7C15) % 2**64} for i in range(60_000)}
    want = {(k, v["hash_int"] - (1 << 64 if v["hash_int"] >= 1 << 63 else 0)) for k, v in entries.items()}
    for name, text in (("a", json.dumps({"entries": entries})), ("b", json.dumps({"entries": entries}, indent=1))):
        (tmp_path / f"{name}.json").write_text(text)
        own = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        try:
            out = logs.read_hashes(spark, str(tmp_path / f"{name}.json"))
            assert out.rdd.getNumPartitions() > 4 and {tuple(r) for r in out.collect()} == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", own)
    odd = {"entries": {"a}b": {"hash_int": 1}, "c": {"hash_int": 2**64 - 1}}}
    for name, doc, rows in (("odd", odd, {("a}b", 1), ("c", -1)}), ("more", {"v": 1, **odd}, {("a}b", 1), ("c", -1)}), ("none", {"entries": {}}, set())):
        (tmp_path / name).write_text(json.dumps(doc))
        assert {tuple(r) for r in logs.read_hashes(spark, str(tmp_path / name)).collect()} == rows


def test_hash_cache_written_entry_by_entry(spark, tmp_path):
    import json

    keys = ["a/b", 'q"]: {x', "ä\\n", "}"]
    rows = spark.createDataFrame([(k, str(i + 2**63)) for i, k in enumerate(keys)] + [(None, "1"), ("n", None)], "key string, hash_int string")
    sinks.write_hashes(rows.repartition(3), str(tmp_path / "c"))
    docs = [json.loads(p.read_text()) for p in (tmp_path / "c").glob("part-*")]
    assert {k: v["hash_int"] for d in docs for k, v in d["entries"].items()} == {k: i + 2**63 for i, k in enumerate(keys)}
    assert {r.key: r.hash for r in logs.read_hashes(spark, str(tmp_path / "c")).collect()} == {k: i - 2**63 for i, k in enumerate(keys)}
