"""Queries on recorded events: bursts, frames, intervals and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, timefmt
from tidemark.operators import audit, bursts, sanitize, segmented, temporal
from tidemark.plans.mapping import BURSTS_SQL, DAY, EVENTS_SQL, FRAMES_SQL, GAP_US, TOTALS_US, events, frames
from tidemark.plans.registry import ORACLES, query
from tidemark.schemas import PADDING_US
from tidemark.streaming import live

HOUR_US = 3_600_000_000


@query("category_counts", f"WITH {EVENTS_SQL} SELECT session_id, category, count(*) AS n FROM ev GROUP BY ALL")
def category_counts(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("session_id", "category").agg(F.count("*").alias("n"))


@query("disabled_filter", f"WITH {EVENTS_SQL} SELECT event_id, category FROM ev WHERE category NOT IN ('move', 'scroll')")
def disabled_filter(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.where(text.enabled(F.col("category"), ["move", "scroll", "no such"])).select("event_id", "category")


@query("burst_summary", f"WITH {BURSTS_SQL} SELECT session_id, category, burst_no, start_ts, end_ts, num_events, burst_id FROM ids")
def burst_summary(spark, sf_dir) -> DataFrame:
    return bursts.summaries(bursts.with_bursts(events(spark, sf_dir), GAP_US)).drop("first_event", "last_event")


@query("burst_events", f"WITH {BURSTS_SQL} SELECT event_id, burst_no, min(ts) OVER (PARTITION BY session_id, category, burst_no) AS burst_start FROM burst")
def burst_events(spark, sf_dir) -> DataFrame:
    return bursts.with_bursts(events(spark, sf_dir), GAP_US).select("event_id", "burst_no", "burst_start")


@query("burst_numbers_in_parts", f"WITH {BURSTS_SQL} SELECT event_id, burst_no FROM burst")
def burst_numbers_in_parts(spark, sf_dir) -> DataFrame:
    """As ``burst_events``, for sessions too large for one task: three days at a time."""
    return bursts.with_bursts(events(spark, sf_dir), GAP_US, part=3 * DAY).select("event_id", "burst_no")


_TOTAL = " ".join(f"WHEN '{c}' THEN {t}" for c, t in TOTALS_US.items())
MIDS_SQL = f"""WITH RECURSIVE {BURSTS_SQL},
    seq AS (
        SELECT *, row_number() OVER (PARTITION BY session_id, category, burst_no ORDER BY ts, event_id) AS rn,
               CASE category {_TOTAL} END AS total
        FROM burst),
    fold AS (
        SELECT session_id, category, burst_no, rn, monitor_index AS mon,
               [{{'t': ts, 'm': monitor_index, 'e': event_id}}] AS q,
               CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS INTEGER) AS monitor_index, CAST(NULL AS BIGINT) AS event_id
        FROM seq WHERE rn = 1
        UNION ALL
        SELECT s.session_id, s.category, s.burst_no, s.rn, s.monitor_index,
               list_append(CASE WHEN s.monitor_index <> f.mon OR s.ts - f.q[1].t <= s.total THEN f.q ELSE f.q[list_position(d, list_min(d)) + 1 :] END,
                           {{'t': s.ts, 'm': s.monitor_index, 'e': s.event_id}}),
               CASE WHEN s.monitor_index <> f.mon THEN 'monitor_switch' WHEN s.ts - f.q[1].t > s.total THEN 'max_length_exceeded' END,
               CASE WHEN s.monitor_index <> f.mon THEN s.ts WHEN s.ts - f.q[1].t > s.total THEN f.q[list_position(d, list_min(d))].t END,
               CASE WHEN s.monitor_index <> f.mon THEN s.monitor_index WHEN s.ts - f.q[1].t > s.total THEN f.q[list_position(d, list_min(d))].m END,
               CASE WHEN s.monitor_index <> f.mon THEN s.event_id WHEN s.ts - f.q[1].t > s.total THEN f.q[list_position(d, list_min(d))].e END
        FROM (SELECT *, list_transform(q, lambda x: abs(2 * x.t - q[1].t - q[len(q)].t)) AS d FROM fold) f
        JOIN seq s ON s.session_id = f.session_id AND s.category = f.category AND s.burst_no = f.burst_no AND s.rn = f.rn + 1),
    mids AS (SELECT session_id, category, burst_no, reason, ts, monitor_index, event_id FROM fold WHERE reason IS NOT NULL)"""


@query("burst_mid_splits", f"{MIDS_SQL} SELECT * FROM mids WHERE reason = 'max_length_exceeded'")
def burst_mid_splits(spark, sf_dir) -> DataFrame:
    return bursts.middles(bursts.with_bursts(events(spark, sf_dir), GAP_US), TOTALS_US).where(F.col("reason") == bursts.SPLIT)


@query("monitor_switches", f"{MIDS_SQL} SELECT * FROM mids WHERE reason = 'monitor_switch'")
def monitor_switches(spark, sf_dir) -> DataFrame:
    return bursts.middles(bursts.with_bursts(events(spark, sf_dir), GAP_US), TOTALS_US).where(F.col("reason") == bursts.SWITCH)


BOUNDS_SQL = f"""{MIDS_SQL},
    bounds AS (
        SELECT session_id, category, burst_id, 'start' AS request_state, 'stale' AS reason, start_ts AS ts, first_event AS event_id FROM ids
        UNION ALL SELECT session_id, category, burst_id, 'end', 'stale', end_ts, last_event FROM ids
        UNION ALL SELECT m.session_id, m.category, burst_id, 'mid', reason, ts, event_id FROM mids m JOIN ids USING (session_id, category, burst_no))"""


@query("burst_boundaries", f"{BOUNDS_SQL} SELECT *, category || '_' || request_state || '_' || reason AS label FROM bounds")
def burst_boundaries(spark, sf_dir) -> DataFrame:
    rows = bursts.boundaries(events(spark, sf_dir), GAP_US, TOTALS_US).drop("monitor_index")
    return rows.withColumn("label", text.reason(F.col("category"), F.col("request_state"), F.col("reason")))


def _known(name: str):
    """-1 stands for null, so that a column of numbers stays one in any client."""
    return F.coalesce(F.col(name), F.lit(-1)).alias(name)


def _probes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).where("category <> 'move'").select("session_id", "event_id", "ts", "monitor_index")


@query(
    "frame_asof_before",
    f"WITH {FRAMES_SQL} SELECT e.event_id, coalesce(f.frame_id, -1) AS frame_id, coalesce(f.frame_ts, -1) AS frame_ts FROM (SELECT *, ts - {PADDING_US} AS probe FROM ev WHERE category <> 'move') e ASOF LEFT JOIN fr f ON e.session_id = f.session_id AND e.probe >= f.frame_ts",
)
def frame_asof_before(spark, sf_dir) -> DataFrame:
    probes = _probes(spark, sf_dir).withColumn("probe", F.col("ts") - PADDING_US)
    shots = frames(spark, sf_dir)
    found = temporal.asof(probes, shots.withColumn("at", F.col("frame_ts")), ["session_id"], "probe", "frame_ts", ["frame_id", "at"], tie="frame_id")
    return found.select("event_id", _known("frame_id"), _known("at").alias("frame_ts"))


@query(
    "frame_asof_in_parts",
    f"WITH {FRAMES_SQL} SELECT e.event_id, coalesce(f.frame_id, -1) AS frame_id FROM (SELECT *, ts - {PADDING_US} AS probe FROM ev WHERE category <> 'move') e ASOF LEFT JOIN fr f ON e.session_id = f.session_id AND e.probe >= f.frame_ts",
)
def frame_asof_in_parts(spark, sf_dir) -> DataFrame:
    """As ``frame_asof_before``, for sessions too large for one task: two days at a time."""
    probes = _probes(spark, sf_dir).withColumn("probe", F.col("ts") - PADDING_US)
    found = temporal.asof_in_parts(probes, frames(spark, sf_dir), ["session_id"], "probe", "frame_ts", ["frame_id"], 2 * DAY, tie="frame_id")
    return found.select("event_id", _known("frame_id"))


@query(
    "frame_asof_after_pref",
    f"""WITH {FRAMES_SQL},
        one AS (SELECT e.event_id, e.session_id, e.ts, f.frame_id AS same_id FROM (SELECT * FROM ev WHERE category <> 'move') e
                ASOF LEFT JOIN fr f ON e.session_id = f.session_id AND e.monitor_index = f.monitor_index AND e.ts <= f.frame_ts),
        two AS (SELECT o.*, f.frame_id AS any_id FROM one o ASOF LEFT JOIN fr f ON o.session_id = f.session_id AND o.ts <= f.frame_ts)
        SELECT event_id, coalesce(same_id, any_id, -1) AS frame_id FROM two""",
)
def frame_asof_after_pref(spark, sf_dir) -> DataFrame:
    found = temporal.asof_preferring(_probes(spark, sf_dir), frames(spark, sf_dir), ["session_id"], "monitor_index", "ts", "frame_ts", ["frame_id"], tie="frame_id")
    return found.select("event_id", _known("frame_id"))


@query(
    "frame_end_newest",
    f"""WITH {BURSTS_SQL},
        fr AS (SELECT session_id, event_id AS frame_id, ts AS frame_ts FROM ev WHERE category = 'move'),
        ends AS (SELECT session_id, burst_id, end_ts + {PADDING_US} AS low,
                        coalesce(lead(start_ts) OVER (PARTITION BY session_id, category ORDER BY start_ts), end_ts + {GAP_US} + 1000000) AS decided FROM ids)
        SELECT e.session_id, e.burst_id, CASE WHEN f.frame_ts >= e.low THEN f.frame_id ELSE -1 END AS frame_id
        FROM ends e ASOF LEFT JOIN fr f ON e.session_id = f.session_id AND e.decided >= f.frame_ts""",
)
def frame_end_newest(spark, sf_dir) -> DataFrame:
    ids = bursts.summaries(bursts.with_bursts(events(spark, sf_dir), GAP_US))
    rows = temporal.link_next(ids, ["session_id", "category"], "start_ts", ["first_event"], "decided", F.col("end_ts") + GAP_US + 1_000_000)
    rows = rows.select("session_id", "burst_id", (F.col("end_ts") + PADDING_US).alias("low"), "decided")
    return temporal.newest_within(rows, frames(spark, sf_dir), ["session_id"], "low", "decided", "frame_ts", ["frame_id"], tie="frame_id").select("session_id", "burst_id", _known("frame_id"))


@query(
    "link_boundaries",
    f"{BOUNDS_SQL} SELECT session_id, category, burst_id, request_state, ts, coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id, request_state), -1) AS end_ts FROM bounds",
)
def link_boundaries(spark, sf_dir) -> DataFrame:
    rows = bursts.boundaries(events(spark, sf_dir), GAP_US, TOTALS_US)
    return temporal.link_next(rows, ["session_id"], "ts", ["event_id", "request_state"]).select("session_id", "category", "burst_id", "request_state", "ts", _known("end_ts"))


@query("links_in_parts", f"WITH {EVENTS_SQL} SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id), -1) AS end_ts FROM ev")
def links_in_parts(spark, sf_dir) -> DataFrame:
    """Every event linked to the next of its session, three days at a time."""
    return segmented.link_next_in_parts(events(spark, sf_dir), ["session_id"], "ts", ["event_id"], 3 * DAY, last=F.lit(-1).cast("bigint")).select("event_id", "end_ts")


def _records(spark, sf_dir) -> DataFrame:
    """Views as records: every tenth lacks a path; the end is known for every third."""
    rows = frames(spark, sf_dir)
    return rows.select("session_id", "frame_id", "frame_ts", F.when(F.col("hash") % 10 != 0, F.col("path")).alias("path"), F.when(F.col("hash") % 3 == 0, F.col("frame_ts") + HOUR_US).alias("own_end"))


RECORDS_SQL = FRAMES_SQL + f""",
    rec AS (SELECT session_id, frame_id, frame_ts, CASE WHEN hash % 10 <> 0 THEN path END AS path,
                   CASE WHEN hash % 3 = 0 THEN frame_ts + {HOUR_US} END AS own_end FROM fr),
    lasts AS (SELECT session_id, max(ts) + 1 AS last_ts FROM ev GROUP BY 1),
    spans AS (SELECT session_id, frame_id, frame_ts AS lo,
                     coalesce(lead(frame_ts) OVER (PARTITION BY session_id ORDER BY frame_ts, frame_id), own_end, last_ts) AS hi
              FROM rec JOIN lasts USING (session_id) WHERE path IS NOT NULL)"""


@query("assign_halfopen", f"WITH {RECORDS_SQL} SELECT e.event_id, s.frame_id FROM ev e JOIN spans s ON e.session_id = s.session_id AND e.ts >= s.lo AND e.ts < s.hi")
def assign_halfopen(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir)
    spans = sanitize.linked(sanitize.valid(_records(spark, sf_dir), "frame_ts", "path"), rows, "session_id", "frame_ts", "own_end", ["frame_id"], "ts")
    return temporal.assign_intervals(rows, spans, ["session_id"], "ts", "start", "end", ["frame_id"]).select("event_id", "frame_id")


@query("assign_leftopen", f"WITH {RECORDS_SQL} SELECT e.event_id, s.frame_id FROM ev e JOIN spans s ON e.session_id = s.session_id AND e.ts > s.lo AND e.ts <= s.hi")
def assign_leftopen(spark, sf_dir) -> DataFrame:
    good = sanitize.valid(_records(spark, sf_dir), "frame_ts", "path")
    return sanitize.sanitized(good, events(spark, sf_dir), "session_id", "frame_ts", "own_end", ["frame_id"], "ts", "frame_id").select("event_id", "frame_id")


@query(
    "sanitize_counts",
    f"""WITH {RECORDS_SQL},
        n AS (SELECT session_id, count(*) AS n_events FROM ev GROUP BY 1),
        r AS (SELECT session_id, count(*) AS n_records, count(path) AS n_valid FROM rec GROUP BY 1),
        a AS (SELECT e.session_id, count(*) AS n_assigned FROM ev e JOIN spans s ON e.session_id = s.session_id AND e.ts > s.lo AND e.ts <= s.hi GROUP BY 1),
        o AS (SELECT e.session_id, count(*) AS n_outside FROM ev e JOIN (SELECT session_id, min(lo) AS lo, max(hi) AS hi FROM spans GROUP BY 1) b
              ON e.session_id = b.session_id WHERE e.ts < b.lo OR e.ts >= b.hi GROUP BY 1)
        SELECT session_id, coalesce(n_records, 0) AS n_records, coalesce(n_valid, 0) AS n_valid, coalesce(n_events, 0) AS n_events,
               coalesce(n_assigned, 0) AS n_assigned, coalesce(n_outside, 0) AS n_outside
        FROM r FULL JOIN n USING (session_id) LEFT JOIN a USING (session_id) LEFT JOIN o USING (session_id)""",
)
def sanitize_counts(spark, sf_dir) -> DataFrame:
    return sanitize.counts(_records(spark, sf_dir), events(spark, sf_dir), "session_id", "frame_ts", "path", "own_end", ["frame_id"], "ts", "frame_id")


def _captured(spark, sf_dir) -> DataFrame:
    """Keys as an aggregator would have kept them: every seventh event lost, every fifth twice."""
    rows = events(spark, sf_dir).where(F.col("k") % 7 != 0)
    return rows.union(rows.where(F.col("k") % 5 == 0)).select("session_id", "ts")


CAPTURED_SQL = EVENTS_SQL + """,
    caught AS (SELECT session_id, ts FROM ev WHERE k % 7 <> 0 UNION ALL SELECT session_id, ts FROM ev WHERE k % 7 <> 0 AND k % 5 = 0)"""


@query(
    "reconcile_events",
    f"""WITH {CAPTURED_SQL}, c AS (SELECT session_id, ts, count(*) AS n FROM caught GROUP BY ALL)
        SELECT event_id, coalesce(n, 0) AS n_captured, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'unique' ELSE 'duplicate' END AS status
        FROM ev LEFT JOIN c USING (session_id, ts)""",
)
def reconcile_events(spark, sf_dir) -> DataFrame:
    return audit.reconcile(events(spark, sf_dir), _captured(spark, sf_dir), ["session_id", "ts"]).select("event_id", "n_captured", "status")


@query("orphan_events", f"WITH {CAPTURED_SQL} SELECT event_id, ts FROM ev ANTI JOIN caught USING (session_id, ts)")
def orphan_events(spark, sf_dir) -> DataFrame:
    return audit.orphans(events(spark, sf_dir), _captured(spark, sf_dir), ["session_id", "ts"]).select("event_id", "ts")


@query("distinct_requests", f"{BOUNDS_SQL} SELECT session_id, ts, reason, min(event_id) AS event_id FROM bounds GROUP BY ALL")
def distinct_requests(spark, sf_dir) -> DataFrame:
    rows = bursts.boundaries(events(spark, sf_dir), GAP_US, TOTALS_US)
    return sanitize.once(rows, ["session_id", "ts", "reason"], ["event_id"]).select("session_id", "ts", "reason", "event_id")


@query(
    "category_intervals",
    f"""{BOUNDS_SQL},
        w AS (SELECT *, lag(request_state) OVER o AS before, lag(ts) OVER o AS start_ts FROM bounds WHERE request_state <> 'mid'
              WINDOW o AS (PARTITION BY session_id, category ORDER BY ts, CASE request_state WHEN 'start' THEN 0 ELSE 1 END, event_id))
        SELECT session_id, category, start_ts, ts AS end_ts FROM w WHERE request_state = 'end' AND before = 'start'""",
)
def category_intervals(spark, sf_dir) -> DataFrame:
    return audit.category_intervals(bursts.boundaries(events(spark, sf_dir), GAP_US, TOTALS_US))


@query(
    "throttled_events",
    f"""WITH RECURSIVE {EVENTS_SQL},
        seq AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY ts, event_id) AS rn FROM ev),
        fold AS (
            SELECT session_id, category, rn, event_id, ts AS last, true AS kept FROM seq WHERE rn = 1
            UNION ALL
            SELECT s.session_id, s.category, s.rn, s.event_id,
                   CASE WHEN s.event_type NOT IN ('mouse_move', 'key_press', 'key_release') OR s.ts - f.last >= {DAY} THEN s.ts ELSE f.last END,
                   s.event_type NOT IN ('mouse_move', 'key_press', 'key_release') OR s.ts - f.last >= {DAY}
            FROM fold f JOIN seq s ON s.session_id = f.session_id AND s.category = f.category AND s.rn = f.rn + 1)
        SELECT event_id FROM fold WHERE kept""",
)
def throttled_events(spark, sf_dir) -> DataFrame:
    always = ~F.col("event_type").isin("mouse_move", "key_press", "key_release")
    return bursts.throttled(events(spark, sf_dir), DAY, always, ["session_id", "category"]).select("event_id")


@query("throttled_in_parts", ORACLES["throttled_events"])
def throttled_in_parts(spark, sf_dir) -> DataFrame:
    """As ``throttled_events``, for sessions too large for one task: by links to the next event that may be kept, three days at a time."""
    always = ~F.col("event_type").isin("mouse_move", "key_press", "key_release")
    return segmented.throttled_in_parts(events(spark, sf_dir), DAY, always, ["session_id", "category"], 3 * DAY).select("event_id")


@query(
    "live_segments",
    f"""{BOUNDS_SQL}, w AS (SELECT *, lag(ts) OVER (PARTITION BY session_id, burst_id ORDER BY ts, CASE request_state WHEN 'start' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, event_id) AS start_ts FROM bounds)
        SELECT session_id, burst_id, category, coalesce(start_ts, ts) AS start_ts, ts AS end_ts FROM w WHERE request_state <> 'start' AND (start_ts IS NOT NULL OR request_state = 'end')""",
)
def live_segments(spark, sf_dir) -> DataFrame:
    return live.segments(bursts.boundaries(events(spark, sf_dir), GAP_US, TOTALS_US))


@query(
    "window_clip",
    f"""WITH {BURSTS_SQL}, now AS (SELECT max(ts) AS t FROM ev)
        SELECT session_id, category, burst_id, greatest(start_ts, t - {10 * DAY}) AS clip_start, least(end_ts, t) AS clip_end
        FROM ids, now WHERE end_ts >= t - {10 * DAY} AND start_ts <= t""",
)
def window_clip(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir)
    ids = bursts.summaries(bursts.with_bursts(rows, GAP_US))
    now = rows.agg(F.max("ts")).first()[0]
    return live.seen(ids, now, 10 * DAY).select("session_id", "category", "burst_id", F.col("start_ts").alias("clip_start"), F.col("end_ts").alias("clip_end"))


@query("newest_frames", f"WITH {FRAMES_SQL} SELECT session_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts DESC, frame_id DESC) AS n FROM fr) WHERE n <= 3")
def newest_frames(spark, sf_dir) -> DataFrame:
    return temporal.newest(frames(spark, sf_dir), ["session_id"], "frame_ts", "frame_id", 3).select("session_id", "frame_id")


@query(
    "filename_ts",
    f"""WITH {FRAMES_SQL} SELECT frame_id, CAST(regexp_extract(path, '([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS seconds, 'move_start' AS reason, 'move' AS category,
        strftime(make_timestamp(frame_ts), '%Y-%m-%d_%H-%M-%S-%f') AS stamped FROM fr""",
)
def filename_ts(spark, sf_dir) -> DataFrame:
    rows = frames(spark, sf_dir)
    path = F.col("path")
    return rows.select("frame_id", timefmt.frame_time(path).alias("seconds"), timefmt.frame_reason(path).alias("reason"), timefmt.frame_category(path).alias("category"), timefmt.stamp((F.col("frame_ts") + 0.25) / 1e6).alias("stamped"))
