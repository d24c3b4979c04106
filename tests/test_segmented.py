"""Scans in parts give what the plain forms give, also where one session holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bursts, dedupe, labeling, segmented, temporal


@pytest.fixture(scope="module")
def rows(spark):
    """One session of 3,000 rows with ties and pauses, a small one, and one of a single row."""
    rng = random.Random(3)
    out, ts = [], 0
    for i in range(3000):
        ts += rng.choice([0, 1, 3, 20, 40, 41, 100, 100, 700]) if i % 300 else 5000
        out.append((i, "a", ts, rng.choice(["mouse_move", "mouse_scroll", "mouse_down", "key_press", None]), rng.choice([None, 0, 1, 3, 7, 255, 256, -1])))
    out += [(3000 + i, "b", 7 * i, "mouse_scroll" if i % 2 else "mouse_move", i) for i in range(50)] + [(3050, "c", 5, None, None)]
    return spark.createDataFrame(out, "id long, s string, ts long, event_type string, h long").repartition(5).cache()


def same(a, b):
    left, right = sorted(map(tuple, a.collect()), key=str), sorted(map(tuple, b.collect()), key=str)
    assert left == right and left


PARTS = [150, 10**9]


@pytest.mark.parametrize("part", PARTS)
def test_windows(rows, part):
    by, order = ["s"], ["ts", "id"]
    same(segmented.link_next_in_parts(rows, by, "ts", ["id"], part).select("id", "end_ts"), temporal.link_next(rows, by, "ts", ["id"]).select("id", "end_ts"))
    same(segmented.chunks_in_parts(rows, by, "ts", ["id"], 7, part).select("id", "chunk_index"), temporal.chunks(rows, by, order, 7).select("id", "chunk_index"))
    same(segmented.runs_in_parts(rows, by, "ts", ["id"], "event_type", part).select("id", "run"), temporal.runs(rows, by, order, "event_type").select("id", "run"))
    typed = rows.fillna("other", ["event_type"])
    same(segmented.reordered_in_parts(typed, by, "ts", ["id"], part).select("id", F.col("position").cast("int")), labeling.reordered(typed, by, order).select("id", "position"))


@pytest.mark.parametrize("part", [150, 10**9])
@pytest.mark.parametrize("every", [41, 100])
def test_throttle(rows, part, every):
    typed = rows.fillna("other", ["event_type"])
    always = F.col("event_type") == "mouse_down"
    same(segmented.throttled_in_parts(typed, every, always, ["s"], part, tie="id").select("id"), bursts.throttled(typed, every, always, ["s"], tie="id").select("id"))


@pytest.mark.parametrize("part", [9000, 60000])
@pytest.mark.parametrize("threshold", [0, 1, 5])
def test_dedupe(rows, part, threshold):
    same(segmented.keep_changed_in_parts(rows, ["s"], "ts", ["id"], "h", part, threshold).select("id"), dedupe.keep_changed(rows, ["s"], ["ts", "id"], "h", threshold).select("id"))


def test_dedupe_where_every_part_changes(spark):
    """Hashes of which each part's fold depends on what comes in: rounds go on until all agree."""
    rows = spark.createDataFrame([(i, "a", i, 1 if i % 2 else 2) for i in range(40)] + [(40 + i, "a", 40 + i, 3) for i in range(40)], "id long, s string, ts long, h long")
    same(segmented.keep_changed_in_parts(rows, ["s"], "ts", ["id"], "h", 10, 1).select("id"), dedupe.keep_changed(rows, ["s"], ["ts", "id"], "h", 1).select("id"))


def test_dedupe_of_many_small_parts(spark):
    """20,000 parts of few rows are no 20,000 groups of pandas: no plan has such groups, and results stay."""
    rows = spark.range(60_000).selectExpr("id", "id % 4000 s", "id ts", "pmod(xxhash64(id), 8) h")
    got = segmented.keep_changed_in_parts(rows, ["s"], "ts", ["id"], "h", 12_000)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    same(got.select("id"), dedupe.keep_changed(rows, ["s"], ["ts", "id"], "h").select("id"))


def test_empty(spark, rows):
    none = rows.limit(0)
    always = F.col("event_type") == "mouse_down"
    assert segmented.throttled_in_parts(none, 41, always, ["s"], 10, tie="id").collect() == []
    assert segmented.keep_changed_in_parts(none, ["s"], "ts", ["id"], "h", 10).collect() == []
    assert segmented.reordered_in_parts(none, ["s"], "ts", ["id"], 10).collect() == []
