"""The driver's tables seen as recordings: sessions are users, frames are views, captions are conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import category

TYPES = {"click": "mouse_down", "view": "mouse_move", "purchase": "key_press", "signup": "key_release", "error": "mouse_scroll"}
DAY = 86_400_000_000
#: Thresholds fit to events that are hours apart.
GAP_US = DAY
TOTALS_US = {"click": 2 * DAY, "move": 4 * DAY, "scroll": 3 * DAY, "key": 6 * DAY}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id``, ``session_id``, ``ts`` (microseconds), ``event_type``, ``category``, ``k``, ``monitor_index``."""
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.element_at(types, F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return rows.select("event_id", "session_id", "ts", "event_type", category(F.col("event_type")).alias("category"), "k", (F.col("k") % 3).alias("monitor_index"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as frames: ``session_id``, ``frame_id``, ``frame_ts``, ``monitor_index``, ``hash``, ``path``."""
    rows = events(spark, sf_dir).where("category = 'move'")
    path = F.concat(F.lit("screens/"), F.format_string("%.6f", F.col("ts") / 1e6), F.lit("_reason_move_start.jpg"))
    return rows.select("session_id", F.col("event_id").alias("frame_id"), F.col("ts").alias("frame_ts"), "monitor_index", F.col("k").cast("bigint").alias("hash"), path.alias("path"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as captions: ``session_id``, ``turn``, ``start_seconds``, ``end_seconds``, ``caption``."""
    length = F.length("text") % 4
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("session_id"), "turn", (F.col("turn") * 2).cast("int").alias("start_seconds"), (F.col("turn") * 2 + length).cast("int").alias("end_seconds"), F.col("text").alias("caption"))


# The same views in SQL, to be put before a query.
EVENTS_SQL = """
    ev0 AS (
        SELECT event_id, user_id AS session_id, epoch_us(ts) AS ts, event_type AS raw_type,
               CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k
        FROM events),
    ev AS (
        SELECT event_id, session_id, ts,
               CASE raw_type WHEN 'click' THEN 'mouse_down' WHEN 'view' THEN 'mouse_move' WHEN 'purchase' THEN 'key_press'
                             WHEN 'signup' THEN 'key_release' WHEN 'error' THEN 'mouse_scroll' END AS event_type,
               CASE raw_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'key'
                             WHEN 'signup' THEN 'key' WHEN 'error' THEN 'scroll' END AS category,
               k, k % 3 AS monitor_index
        FROM ev0)"""
FRAMES_SQL = EVENTS_SQL + """,
    fr AS (
        SELECT session_id, event_id AS frame_id, ts AS frame_ts, monitor_index, CAST(k AS BIGINT) AS hash,
               'screens/' || format('{:.6f}', ts / 1e6) || '_reason_move_start.jpg' AS path
        FROM ev WHERE category = 'move')"""
CAPTIONS_SQL = """
    cap AS (
        SELECT conv_id AS session_id, turn, CAST(turn * 2 AS INTEGER) AS start_seconds,
               CAST(turn * 2 + length(text) % 4 AS INTEGER) AS end_seconds, text AS caption
        FROM conversations)"""
BURSTS_SQL = EVENTS_SQL + f""",
    gaps AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER w > {GAP_US} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins
        FROM ev WINDOW w AS (PARTITION BY session_id, category ORDER BY ts, event_id)),
    burst AS (
        SELECT *, CAST(sum(begins) OVER (PARTITION BY session_id, category ORDER BY ts, event_id) AS BIGINT) AS burst_no FROM gaps),
    summed AS (
        SELECT session_id, category, burst_no, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(event_id, ts) AS first_event,
               arg_max(event_id, ts) AS last_event, count(*) AS num_events
        FROM burst GROUP BY ALL),
    ids AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ts, first_event) AS burst_id FROM summed)"""
