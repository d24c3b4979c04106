"""The chunk store against a dictionary, and captions that cover many rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labeling
from tidemark.sources.store import ChunkStore

SCHEMA = "session_id string, chunk_index int, turn int, caption string"


def test_last_version_wins(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = ChunkStore(spark, f"file://{tmp_path}/s", ["session_id", "chunk_index"], buckets=3)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.keys_done() is None and store.compact() == 0
    for nth in range(5):
        new = {(s, c): [(t, f"{nth} {s} {t}") for t in range(rng.randint(1, 3))] for s in ("a", "b", None) for c in (0, 1, None) if rng.random() < 0.5}
        gone = [k for k in want if k not in new and rng.random() < 0.3] + ([("z", 9)] if nth == 2 else [])
        rows = spark.createDataFrame([(*k, t, x) for k, v in new.items() for t, x in v], SCHEMA)
        store.upsert(rows, spark.createDataFrame(gone, "session_id string, chunk_index int") if gone else None)
        want |= new | {k: [] for k in gone}
        if nth == 3:
            store.compact()
            assert [kind for _, kind in store.versions()] == ["base"]
        assert sorted(map(tuple, store.read().collect()), key=str) == sorted(((*k, t, x) for k, v in want.items() for t, x in v), key=str)
        assert {tuple(r) for r in store.keys_done().collect()} == set(want)


def test_files_follow_upserts_not_chunks(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", ["session_id", "chunk_index"], buckets=4)
    rows = spark.range(3000).select((F.col("id") % 500).cast("string").alias("session_id"), (F.col("id") % 7).cast("int").alias("chunk_index"), F.col("id").cast("int").alias("turn"), F.lit("x").alias("caption"))
    store.upsert(rows.repartition(8))
    store.upsert(rows.where("chunk_index = 1").repartition(8))
    assert len(list(tmp_path.glob("s/*/*.parquet"))) <= 8


def test_what_was_not_committed_is_not_read(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", ["session_id", "chunk_index"])
    store.upsert(spark.createDataFrame([("a", 0, 1, "first")], SCHEMA))
    store.upsert(spark.createDataFrame([("a", 0, 1, "second")], SCHEMA))
    (tmp_path / "s/delta-000000002/_SUCCESS").unlink()
    assert [r.caption for r in store.read().collect()] == ["first"]
    store.upsert(spark.createDataFrame([("a", 0, 1, "again")], SCHEMA))  # takes the place of the dead one
    assert [r.caption for r in store.read().collect()] == ["again"] and len(store.versions()) == 2


def test_long_captions(spark):
    """A thousand captions over nearly all of 100,000 rows: two rows are looked up for each, and the tail is found without listing any."""
    rows = spark.range(100_000).select(F.lit("a").alias("s"), F.col("id").alias("ts"), F.col("id").alias("e"))
    captions = spark.range(1000).select(F.lit("a").alias("s"), F.col("id").alias("turn"), (F.col("id") * 3).alias("start_seconds"), (90_000 + (F.col("id") * 37) % 8000).alias("end_seconds"))
    found = labeling.match_captions(captions, rows, "s", ["ts", "e"], ["start_seconds", "turn"])
    ends = {r.turn: (r.start_index, r.end_index, r.n_rows) for r in found.collect()}
    last = 90_000 + 999 * 37 % 8000
    top = max(90_000 + t * 37 % 8000 for t in range(1000))
    assert ends[999] == (2997, 99_999, last - 2997 + 1 + 99_999 - max(top, last))
    out = labeling.matched_ends(found, rows, "s", ["ts", "e"], ["ts"])
    assert all((r.first_ts, r.last_ts) == ends[r.turn][:2] for r in out.collect())
    assert "sequence(" not in out._jdf.queryExecution().toString()


def test_rows_of_captions(spark):
    rows = spark.range(50).select(F.lit("a").alias("s"), F.col("id").alias("ts"))
    matches = spark.createDataFrame([("a", 1, 0, 49), ("a", 2, 7, 8), ("a", 3, 16, 16), ("b", 4, 0, 3)], "s string, turn int, start_index int, end_index int")
    got = {(r.turn, r.row_index, r.ts) for r in labeling.matched_rows(matches, rows, "s", ["ts"], ["ts"], block=8).collect()}
    assert got == {(t, i, i) for t, a, b in ((1, 0, 49), (2, 7, 8), (3, 16, 16)) for i in range(a, b + 1)}
