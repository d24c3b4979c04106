"""Queries of scalar functions, frames and cursor paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import accessibility, geometry, text, timefmt
from tidemark.operators import audit, cursor, labeling
from tidemark.plans.label_queries import ACTED_SQL, _acted
from tidemark.plans.mapping import DAY, EVENTS_SQL, FRAMES_SQL, events, frames
from tidemark.plans.registry import query
from tidemark.schemas import MONITOR

MONITORS = ((0, 0, 600, 400), (600, 0, 500, 400), (0, 400, 1100, 300))


def _monitors():
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(m, ("left", "top", "width", "height"), strict=True))).cast(MONITOR) for m in MONITORS))


_ON = [f"(k * 17 >= {x} AND k * 17 < {x + w} AND k * 7 >= {y} AND k * 7 < {y + h})" for x, y, w, h in MONITORS]


@query(
    "monitor_lookup",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN {_ON[0]} THEN 0 WHEN {_ON[1]} THEN 1 WHEN {_ON[2]} THEN 2 ELSE 0 END AS of_event,
        CASE WHEN {_ON[0]} THEN 1 WHEN {_ON[1]} THEN 2 WHEN {_ON[2]} THEN 3 ELSE 0 END AS of_frame FROM ev""",
)
def monitor_lookup(spark, sf_dir) -> DataFrame:
    x, y = F.col("k") * 17, F.col("k") * 7
    return events(spark, sf_dir).select("event_id", geometry.monitor_at(x, y, _monitors()).alias("of_event"), geometry.monitor_at(x, y, _monitors(), first=1).alias("of_frame"))


@query(
    "frame_sizes",
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, k * 60 + 100 AS w, (99 - k) * 60 + 100 AS h FROM ev),
        t AS (SELECT *, least(CASE WHEN w >= h THEN 1920 ELSE 1080 END / w, CASE WHEN w >= h THEN 1080 ELSE 1920 END / h, 1.0) AS scale, least(1280 / w, 720 / h) AS fit FROM s)
        SELECT event_id, CAST(CASE WHEN scale >= 1 THEN w ELSE greatest(1, round_even(w * scale, 0)) END AS INTEGER) AS small_w,
               CAST(CASE WHEN scale >= 1 THEN h ELSE greatest(1, round_even(h * scale, 0)) END AS INTEGER) AS small_h,
               CAST(trunc(w * fit) AS INTEGER) AS fit_w, CAST(trunc(h * fit) AS INTEGER) AS fit_h,
               CAST(round_even(w * 0.25, 0) AS INTEGER) AS quarter_w, CAST(round_even(h * 0.25, 0) AS INTEGER) AS quarter_h FROM t""",
)
def frame_sizes(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", (F.col("k") * 60 + 100).alias("w"), ((99 - F.col("k")) * 60 + 100).alias("h"))
    w, h = F.col("w"), F.col("h")
    names = ("small_w", "small_h", "fit_w", "fit_h", "quarter_w", "quarter_h")
    sizes = (*geometry.shrunk(w, h, (1920, 1080)), *geometry.fitted(w, h, F.lit(1280), F.lit(720)), *geometry.scaled(w, h, F.lit(0.25)))
    return rows.select("event_id", *(c.cast("int").alias(n) for c, n in zip(sizes, names, strict=True)))


@query(
    "monitor_scales",
    f"WITH {EVENTS_SQL} SELECT event_id, round((k + 1000) / ((k + 300) / 25.4), 6) AS dots, round(96.0 / ((k + 1000) / ((k + 300) / 25.4)), 6) AS scale, CASE greatest(monitor_index - 1, 0) WHEN 0 THEN 0.5 ELSE 0.75 END AS of_frame FROM ev",
)
def monitor_scales(spark, sf_dir) -> DataFrame:
    dots = geometry.dpi(F.col("k") + 1000, F.col("k") + 300)
    return events(spark, sf_dir).select("event_id", F.round(dots, 6).alias("dots"), F.round(geometry.target_scale(dots, 96.0), 6).alias("scale"), geometry.scale_of(F.col("monitor_index"), F.array(F.lit(0.5), F.lit(0.75))).alias("of_frame"))


@query(
    "frame_names",
    f"WITH {FRAMES_SQL} SELECT frame_id, format('{{:.6f}}', frame_ts / 1e6) || '_reason_move_start_stale.jpg' AS name, CAST(hash % 100 AS INTEGER) / 4.0 AS seconds FROM fr",
)
def frame_names(spark, sf_dir) -> DataFrame:
    """A frame's name from its time and reason, and back: the time before the underscore of another name."""
    why = text.reason(F.lit("move"), F.lit("start"), F.lit("stale"))
    other = F.concat(F.lit("d/"), (F.col("hash") / 4).cast("string"), F.lit("_x.jpg"))
    return frames(spark, sf_dir).select("frame_id", text.frame_name(F.col("frame_ts") / 1e6, why).alias("name"), timefmt.prefix_time(other).alias("seconds"))


@query(
    "text_functions",
    """SELECT conv_id, turn, replace(replace(replace(replace(text, '\\', '\\\\'), chr(13), '\\r'), chr(10), '\\n'), '''', '\\''') AS quoted,
              'data:text/plain;base64,' || base64(encode(text)) AS url, 'Log: ' || text || '.' AS filled,
              '[' || turn || ']' AS salvaged FROM conversations""",
)
def text_functions(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answer = F.concat(F.lit("Sure, here: ["), F.col("turn").cast("string"), F.lit("] - done"))
    url = text.data_url(F.col("text").cast("binary"), F.lit("text/plain"))
    return rows.select("conv_id", "turn", text.sql_quoted(F.col("text")).alias("quoted"), F.regexp_replace(url, "\\s", "").alias("url"), text.filled("Log: {{LOGS}}.", F.col("text")).alias("filled"), text.salvaged_json(answer).alias("salvaged"))


@query(
    "viewer_marks",
    f"""WITH {ACTED_SQL} SELECT event_id, round(greatest(0.3, 1 - k / 60.0 * 0.7), 6) AS opacity, round(greatest(k / 50.0 - 1.0, 0.5), 6) AS bar,
        CASE WHEN k % 4 = 0 THEN 'yellow' ELSE 'red' END AS colour, CASE WHEN key = 'unknown' THEN '' ELSE key END AS key FROM y""",
)
def viewer_marks(spark, sf_dir) -> DataFrame:
    rows = _acted(spark, sf_dir)
    return rows.select("event_id", F.round(text.opacity(F.col("k"), 60.0), 6).alias("opacity"), F.round(text.bar_length(F.lit(1.0), F.col("k") / 50), 6).alias("bar"), text.button_colour(F.col("details.button")).alias("colour"), F.coalesce(text.key_name(F.col("details.key")), F.lit("")).alias("key"))


@query(
    "useful_elements",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 4 = 0 THEN true WHEN k % 3 = 0 THEN false WHEN k % 3 = 1 THEN true ELSE k % 5 = 0 END AS useful,
        CASE WHEN event_type = 'mouse_move' THEN row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts, event_id) % 10 = 0 ELSE event_type NOT IN ('mouse_up', 'key_release') END AS looked_up FROM ev""",
)
def useful_elements(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    role = F.when(k % 3 == 0, "AXGroup").when(k % 3 == 1, "AXButton").otherwise("AXOther")
    element = F.to_json(F.struct(role.alias("AXRole"), F.when(k % 4 == 0, "Save").otherwise(" ").alias("AXTitle"), F.when(k % 5 == 0, F.struct(F.lit("Window").alias("AXTitle"))).alias("_parent")))
    rows = accessibility.sampled(events(spark, sf_dir), ["session_id"], ["ts", "event_id"])
    return rows.select("event_id", accessibility.useful(element).alias("useful"), "looked_up")


@query(
    "cursor_movements",
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, k * 17 AS x, k * 7 AS y, lag(k) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM ev)
        SELECT event_id, CAST(b * 17 AS DOUBLE) AS from_x, CAST(x AS DOUBLE) AS to_x FROM p WHERE b <> k AND x < 1000 AND y < 500 AND b * 17 < 1000 AND b * 7 < 500""",
)
def cursor_movements(spark, sf_dir) -> DataFrame:
    monitor = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1000).alias("width"), F.lit(500).alias("height"))
    rows = events(spark, sf_dir).select("session_id", "event_id", "ts", F.array((F.col("k") * 17).cast("double"), (F.col("k") * 7).cast("double")).alias("cursor_position"), monitor.alias("frame_monitor"))
    moved = cursor.movements(rows, ["session_id"], ["ts", "event_id"], keep=("event_id",))
    return moved.select("event_id", F.get("start", F.lit(0)).alias("from_x"), F.get("end", F.lit(0)).alias("to_x"))


@query(
    "carried_cursor",
    f"""WITH RECURSIVE {EVENTS_SQL},
        acted AS (SELECT session_id, ts // {DAY} AS day, {{'k': k, 'm': CASE monitor_index WHEN 0 THEN 0 ELSE 1 END}} AS e, ts, event_id FROM ev),
        days AS (SELECT session_id, day, list(e ORDER BY ts, event_id) AS own, row_number() OVER (PARTITION BY session_id ORDER BY day) AS nth FROM acted GROUP BY session_id, day),
        fold AS (
            SELECT session_id, day, nth, own AS events, own[1].m AS mon FROM days WHERE nth = 1
            UNION ALL
            SELECT d.session_id, d.day, d.nth, list_concat(CASE WHEN coalesce(third, 0) = 0 THEN off ELSE off[1:third - 1] END, d.own), d.own[1].m
            FROM (SELECT *, list_position(list_transform(off, lambda x: x.m <> off[1].m), true) AS third
                  FROM (SELECT *, list_filter(events[2:], lambda x: NOT CASE mon WHEN 0 THEN x.k * 17 < 1000 AND x.k * 7 < 500
                                  ELSE x.k * 17 BETWEEN 1000 AND 1639 AND x.k * 7 BETWEEN 100 AND 579 END) AS off FROM fold)) f
            JOIN days d ON d.session_id = f.session_id AND d.nth = f.nth + 1)
        SELECT session_id, day, CAST(len(events) AS INTEGER) AS n_events FROM fold""",
)
def carried_cursor(spark, sf_dir) -> DataFrame:
    """Cursor paths that leave a frame's monitor go on in the next frame: a fold from frame to frame."""
    rows = _acted(spark, sf_dir).select("session_id", "event_id", "ts", F.floor(F.col("ts") / DAY).alias("day"), F.struct("cursor_position", "monitor").alias("e"), "monitor")
    days = rows.groupBy("session_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "e"))), lambda x: x["e"]).alias("events"), F.min_by("monitor", F.struct("ts", "event_id")).alias("monitor"))
    return cursor.carried(days, ["session_id"], ["day"]).select("session_id", "day", F.size("events").alias("n_events"))


@query("largest_frame", f"WITH {EVENTS_SQL} SELECT max(k * 17) AS width, max(k * 7) AS height FROM ev")
def largest_frame(spark, sf_dir) -> DataFrame:
    return cursor.largest(events(spark, sf_dir).select((F.col("k") * 17).alias("width"), (F.col("k") * 7).alias("height")))


def _nested(spark, sf_dir) -> DataFrame:
    """A day of a session as one record with its events inside; every third lacks a time of its own."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / DAY))
    event = F.struct((F.col("ts") / 1e6).alias("timestamp"), "event_type")
    days = rows.groupBy("session_id", "day").agg(F.collect_list(event).alias("events"))
    return days.select("session_id", F.when(F.col("day") % 3 != 0, F.col("day").cast("string")).otherwise("none").alias("timestamp"), "events")


@query("harvested_times", f"""WITH {EVENTS_SQL}, d AS (SELECT DISTINCT session_id, ts // {DAY} AS day FROM ev),
        t AS (SELECT session_id, ts / 1e6 AS timestamp FROM ev UNION ALL SELECT session_id, CAST(day AS DOUBLE) FROM d WHERE day % 3 <> 0)
        SELECT session_id, count(*) AS n, max(timestamp) AS last FROM t GROUP BY session_id""")  # fmt: skip
def harvested_times(spark, sf_dir) -> DataFrame:
    return audit.timestamps(_nested(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


@query("inner_events", f"WITH {EVENTS_SQL} SELECT session_id, category, ts AS key, count(*) AS n FROM ev GROUP BY ALL")
def inner_events(spark, sf_dir) -> DataFrame:
    return audit.inner_events(_nested(spark, sf_dir)).groupBy("session_id", "category", "key").agg(F.count("*").alias("n"))


@query("reconstructed", f"WITH {ACTED_SQL} SELECT session_id, count(*) AS n_events, min(ts) / 1e6 AS timestamp, arg_min(ml, ts) AS monitor_left, 'mixed' AS event_type FROM y GROUP BY session_id")
def reconstructed(spark, sf_dir) -> DataFrame:
    """What an aggregation of each session would say; its events are counted, never gathered."""
    first = F.min_by(F.col("monitor.left"), F.struct("ts", "event_id"))
    whole = _acted(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n_events"), (F.min("ts") / 1e6).alias("timestamp"), first.alias("monitor_left"))
    return whole.select("session_id", "n_events", "timestamp", "monitor_left", F.lit("mixed").alias("event_type"))


@query("prompt_bullets", f"WITH {ACTED_SQL} SELECT session_id, '• ' || string_agg(action, chr(10) || '• ' ORDER BY pos) AS bullets FROM every GROUP BY session_id")
def prompt_bullets(spark, sf_dir) -> DataFrame:
    prompts = labeling.prompts(_acted(spark, sf_dir), ["session_id"], ["ts", "event_id"], F.lit("00:00"))
    return prompts.select("session_id", text.actions(F.col("prompt")).alias("bullets"))
