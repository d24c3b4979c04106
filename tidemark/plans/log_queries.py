"""Queries on written logs, formats, totals of aggregations, active bursts and resumed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit, bursts, dataset, models, sanitize, tasks, temporal
from tidemark.plans.label_queries import STAMPED
from tidemark.plans.mapping import BURSTS_SQL, CAPTIONS_SQL, DAY, EVENTS_SQL, FRAMES_SQL, GAP_US, TOTALS_US, captions, events, frames
from tidemark.plans.record_queries import BOUNDS_SQL, CAPTURED_SQL, orphan_events
from tidemark.plans.registry import query
from tidemark.sources import logs, sinks


@query("caption_log", f"WITH {CAPTIONS_SQL} SELECT start_seconds, end_seconds, CAST(turn AS INTEGER) AS chunk_index, caption FROM cap WHERE caption IS NOT NULL")
def caption_log(spark, sf_dir) -> DataFrame:
    """Captions written as a log, twice, of which the second run replaces the first, and read back."""
    rows = captions(spark, sf_dir).where("caption is not null")
    path = sinks.scratch(spark, "captions") + "/log"
    record = rows.select(F.col("start_seconds").alias("start_seconds"), "end_seconds", F.col("turn").cast("int").alias("chunk_index"), "caption")
    sinks.write_json(record.withColumn("caption", F.lit("first run")), path)
    sinks.write_json(record, path)
    read = logs.read_captions(spark, path)
    return read.select(*(F.col(c) for c in ("start_seconds", "end_seconds", "chunk_index", "caption")))


@query("kept_frames", f"WITH {FRAMES_SQL} SELECT frame_id, format('{{:.6f}}', frame_ts / 1e6) || '_reason_move_' || CASE WHEN hash % 2 = 0 THEN 'start' ELSE 'mid' END || '.jpg' AS path FROM fr WHERE hash % 3 = 0")
def kept_frames(spark, sf_dir) -> DataFrame:
    """Frames whose pictures are kept: a third of them, named by time and reason."""
    reason = F.when(F.col("hash") % 2 == 0, "move_start").otherwise("move_mid")
    return sinks.chosen_frames(frames(spark, sf_dir), F.col("hash") % 3 == 0, reason).select("frame_id", "path")


@query("exported_matched", f"WITH {FRAMES_SQL} SELECT 'frame ' || frame_id AS text, {STAMPED.format('frame_ts')} AS start_time, {STAMPED.format('frame_ts + 1500000')} AS end_time, path AS img FROM fr")
def exported_matched(spark, sf_dir) -> DataFrame:
    """Matched captions as export records; the source's format is told from its columns."""
    rows = frames(spark, sf_dir).select(F.concat(F.lit("frame "), F.col("frame_id").cast("string")).alias("caption"), (F.col("frame_ts") / 1e6).alias("start_time"), ((F.col("frame_ts") + 1_500_000) / 1e6).alias("end_time"), F.col("path").alias("img"), F.lit("[]").alias("raw_events"))
    if dataset.format_of(rows.columns) != 1:
        raise ValueError("matched captions were taken for captions")
    return dataset.from_matched(rows)


@query("burst_totals", f"WITH {BURSTS_SQL} SELECT session_id, category, burst_no, num_events, (SELECT any_value(k) FROM ev WHERE ev.event_id = first_event) * 17.0 AS cursor_x FROM summed")
def burst_totals(spark, sf_dir) -> DataFrame:
    """Each aggregation's number of events, and where the cursor was at its first."""
    rows = bursts.with_bursts(events(spark, sf_dir).withColumn("cursor_x", F.col("k") * 17.0), GAP_US)
    return sanitize.totals_of(rows, ["session_id", "category", "burst_no"], ["ts", "event_id"], "cursor_x")


@query(
    "active_at",
    f"""{BOUNDS_SQL}, half AS (SELECT CAST(quantile_disc(ts, 0.5) AS BIGINT) AS now FROM ev)
        SELECT session_id, CAST(sum(CASE request_state WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) AS BIGINT) AS n_active FROM bounds, half WHERE ts <= now GROUP BY session_id""",
)
def active_at(spark, sf_dir) -> DataFrame:
    """How many bursts of each session are open in the middle of the recording."""
    rows = events(spark, sf_dir)
    now = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ts)")).first()[0]
    return temporal.active_bursts(bursts.boundaries(rows, GAP_US, TOTALS_US), ["session_id"], int(now))


@query(
    "burst_of_event",
    f"""WITH {BURSTS_SQL}, started AS (SELECT session_id, category, start_ts, max(burst_id) AS burst_id FROM ids GROUP BY ALL), latest AS (SELECT session_id, start_ts, max(burst_id) AS burst_id FROM ids GROUP BY ALL)
        SELECT e.event_id, coalesce(s.burst_id, l.burst_id) AS burst_id
        FROM ev e ASOF LEFT JOIN started s ON e.session_id = s.session_id AND e.category = s.category AND e.ts - {DAY} >= s.start_ts
                  ASOF LEFT JOIN latest l ON e.session_id = l.session_id AND e.ts >= l.start_ts""",
)
def burst_of_event(spark, sf_dir) -> DataFrame:
    """The burst last begun in an event's category, a day before it; where there is none, the session's latest."""
    ids = bursts.summaries(bursts.with_bursts(events(spark, sf_dir), GAP_US))
    probes = events(spark, sf_dir).withColumn("then", F.col("ts") - DAY)
    return temporal.burst_for(probes, ids, "session_id", "category", "then", "ts").select("event_id", "burst_id")


@query("frame_ring", f"WITH {FRAMES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts DESC, frame_id DESC) AS nth FROM fr) SELECT session_id, count(*) AS n_frames, min(frame_ts) AS oldest, arg_max(frame_id, frame_ts) AS latest FROM n WHERE nth <= 12 GROUP BY session_id")
def frame_ring(spark, sf_dir) -> DataFrame:
    """What a ring of twelve frames holds at the end of each session: how many, its oldest time, its latest frame."""
    ring = temporal.newest(frames(spark, sf_dir), ["session_id"], "frame_ts", "frame_id", 12)
    return ring.groupBy("session_id").agg(F.count("*").alias("n_frames"), F.min("frame_ts").alias("oldest"), F.max_by("frame_id", F.struct("frame_ts", "frame_id")).alias("latest"))


@query("resumed_results", f"WITH {CAPTIONS_SQL} SELECT session_id, turn, CASE WHEN turn % 2 = 0 THEN 'earlier' ELSE caption END AS caption FROM cap WHERE turn % 2 = 0 OR turn % 3 <> 0")
def resumed_results(spark, sf_dir) -> DataFrame:
    """Earlier results and those of a second run, without its failures."""
    rows = captions(spark, sf_dir)
    done = rows.where("turn % 2 = 0").select("session_id", "turn", F.lit("earlier").alias("caption"))
    left = models.pending(rows, done, ["session_id", "turn"])
    fresh = left.select("session_id", "turn", "caption", F.when(F.col("turn") % 3 == 0, "failed").alias("error"))
    return models.resumed(done, fresh).select("session_id", "turn", "caption")


@query("chosen_rows", f"WITH {CAPTIONS_SQL} SELECT session_id, turn, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS task_id FROM cap WHERE turn % 4 < 2")
def chosen_rows(spark, sf_dir) -> DataFrame:
    """Rows of tasks that were chosen for them."""
    rows = captions(spark, sf_dir).select("session_id", "turn", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("task_id"))
    return tasks.only_chosen(rows, rows.where("turn % 4 < 2"), ["session_id", "turn", "task_id"])


@query("boundary_times", f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 3 = 0 THEN ts + 75000 WHEN k % 3 = 1 THEN ts + 1 ELSE ts END AS frame_ts FROM ev")
def boundary_times(spark, sf_dir) -> DataFrame:
    """A boundary's own time: its frame's, else the one in its path, else its event's."""
    rows = events(spark, sf_dir)
    return rows.select("event_id", sanitize.frame_ts(F.when(F.col("k") % 3 == 0, F.col("ts") + 75_000), F.when(F.col("k") % 3 == 1, F.col("ts") + 1), F.col("ts")).alias("frame_ts"))


@query("orphans_shown", f"WITH {CAPTURED_SQL} SELECT event_id, ts FROM ev ANTI JOIN caught USING (session_id, ts) ORDER BY ts, event_id LIMIT 10")
def orphans_shown(spark, sf_dir) -> DataFrame:
    """The first ten events that no aggregation holds."""
    return audit.shown(orphan_events(spark, sf_dir), ["ts", "event_id"])
