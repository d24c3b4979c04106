"""Queries on sessions and captions: merging, chunking, texts, matching, exports and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geometry, text, timefmt
from tidemark.operators import dataset, dedupe, labeling, segmented, tasks, temporal
from tidemark.plans.mapping import CAPTIONS_SQL, DAY, EVENTS_SQL, FRAMES_SQL, captions, events, frames, table
from tidemark.plans.registry import ORACLES, query
from tidemark.schemas import MONITOR


def _shots(spark, sf_dir) -> DataFrame:
    """Events as aggregations: paths begin with the time in quarters of days, every ninth is missing."""
    rows = events(spark, sf_dir)
    path = F.when(F.col("k") % 9 != 0, F.concat(F.lit("screens/"), F.floor(F.col("ts") / (DAY // 4)).cast("string"), F.lit("_x.jpg")))
    return rows.withColumn("screenshot_path", path)


@query(
    "merge_adjacent",
    f"""WITH {EVENTS_SQL},
        p AS (SELECT *, CASE WHEN k % 9 <> 0 THEN CAST(ts // {DAY // 4} AS DOUBLE) END AS begin_at, k % 9 = 0 AS gone FROM ev),
        f AS (SELECT *, first_value(gone) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS lost,
                     last_value(begin_at IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
        g AS (SELECT *, sum(CASE WHEN NOT lost AND begin_at <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g FROM f)
        SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(event_type, ts) AS first_type, arg_max(category, ts) AS last_category, count(*) AS num_merged FROM g GROUP BY session_id, g""",
)
def merge_adjacent(spark, sf_dir) -> DataFrame:
    rows = _shots(spark, sf_dir).select("session_id", "event_id", "ts", "screenshot_path", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("event_type").alias("first_type"), F.col("category").alias("last_category"))
    return labeling.merged(rows, ["session_id"], ["ts", "event_id"], ["start_ts", "first_type"], ["end_ts", "last_category"]).drop("group_no")


@query(
    "gap_segments",
    f"""WITH {FRAMES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts, frame_id) AS pos FROM fr),
        g AS (SELECT *, CASE WHEN abs(frame_ts - lag(frame_ts) OVER (PARTITION BY session_id ORDER BY pos)) > {DAY} THEN 1 ELSE 0 END AS b FROM s)
        SELECT session_id, frame_id, CAST(sum(b) OVER (PARTITION BY session_id ORDER BY pos) + 1 AS BIGINT) AS segment FROM g""",
)
def gap_segments(spark, sf_dir) -> DataFrame:
    rows = tasks.numbered(frames(spark, sf_dir), ["session_id"], ["frame_ts", "frame_id"], "pos")
    return temporal.split_frames(rows, ["session_id"], "pos", "frame_ts", DAY).select("session_id", "frame_id", "segment")


@query("chunk_rows", f"WITH {EVENTS_SQL} SELECT event_id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1) // 20 AS INTEGER) AS chunk_index FROM ev")
def chunk_rows(spark, sf_dir) -> DataFrame:
    return temporal.chunks(events(spark, sf_dir), ["session_id"], ["ts", "event_id"], 20).select("event_id", "chunk_index")


@query("chunk_rows_in_parts", ORACLES["chunk_rows"])
def chunk_rows_in_parts(spark, sf_dir) -> DataFrame:
    return segmented.chunks_in_parts(events(spark, sf_dir), ["session_id"], "ts", ["event_id"], 20, 3 * DAY).select("event_id", "chunk_index")


@query(
    "chunk_frames",
    f"""WITH {FRAMES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts, frame_id) AS pos FROM fr),
        g AS (SELECT *, CASE WHEN frame_ts - lag(frame_ts) OVER (PARTITION BY session_id ORDER BY pos) > {5 * DAY} THEN 1 ELSE 0 END AS b FROM s),
        h AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY pos) AS seg FROM g),
        c AS (SELECT *, (row_number() OVER (PARTITION BY session_id, seg ORDER BY pos) - 1) // 4 AS part FROM h),
        n AS (SELECT session_id, seg, part, count(*) AS n_frames FROM c GROUP BY ALL)
        SELECT session_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, n_frames, CAST(sum(n_frames) OVER w - n_frames AS BIGINT) AS start_seconds
        FROM n WINDOW w AS (PARTITION BY session_id ORDER BY seg, part)""",
)
def chunk_frames(spark, sf_dir) -> DataFrame:
    """Chunks of four frames within segments, numbered through the session; a frame is a second."""
    rows = tasks.numbered(frames(spark, sf_dir), ["session_id"], ["frame_ts", "frame_id"], "pos")
    rows = temporal.split_frames(rows, ["session_id"], "pos", "frame_ts", 5 * DAY)
    return temporal.segment_chunks(rows, ["session_id"], "pos", "segment", 4)


RUNS_SQL = EVENTS_SQL + """,
    c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY session_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS b FROM ev),
    r AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS run FROM c)"""


@query("run_length", f"WITH {RUNS_SQL} SELECT session_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY session_id, run")
def run_length(spark, sf_dir) -> DataFrame:
    rows = temporal.runs(events(spark, sf_dir), ["session_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("session_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("run_length_in_parts", ORACLES["run_length"])
def run_length_in_parts(spark, sf_dir) -> DataFrame:
    rows = segmented.runs_in_parts(events(spark, sf_dir), ["session_id"], "ts", ["event_id"], "event_type", 3 * DAY)
    return rows.groupBy("session_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


BLOCKS_SQL = EVENTS_SQL + """,
    l AS (SELECT *, event_type IN ('mouse_move', 'mouse_scroll') AS loose FROM ev),
    b AS (SELECT *, CASE WHEN loose AND coalesce(lag(loose) OVER (PARTITION BY session_id ORDER BY ts, event_id), false) THEN 0 ELSE 1 END AS begins FROM l),
    k AS (SELECT *, sum(begins) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS block FROM b),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY block, CASE event_type WHEN 'mouse_move' THEN 1 ELSE 0 END, ts, event_id) AS position FROM k)"""


@query("block_reorder", f"WITH {BLOCKS_SQL} SELECT event_id, CAST(position AS INTEGER) AS position FROM o")
def block_reorder(spark, sf_dir) -> DataFrame:
    return labeling.reordered(events(spark, sf_dir), ["session_id"], ["ts", "event_id"]).select("event_id", "position")


@query("block_reorder_in_parts", ORACLES["block_reorder"])
def block_reorder_in_parts(spark, sf_dir) -> DataFrame:
    rows = segmented.reordered_in_parts(events(spark, sf_dir), ["session_id"], "ts", ["event_id"], 3 * DAY)
    return rows.select("event_id", F.col("position").cast("int").alias("position"))


def _acted(spark, sf_dir) -> DataFrame:
    """Events with what a recorder would know: keys, buttons, places on one of two monitors, scrolls either way."""
    rows = events(spark, sf_dir)
    monitor = F.when(F.col("monitor_index") == 0, F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1000).alias("width"), F.lit(500).alias("height"))).otherwise(
        F.struct(F.lit(1000).alias("left"), F.lit(100).alias("top"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    )
    k = F.col("k")
    details = F.struct(
        (k % 2).cast("int").alias("dx"), (k % 3 - 1).cast("int").alias("dy"), F.when(k % 4 == 0, "Button.right").otherwise("Button.left").alias("button"),
        F.when(k % 6 == 0, "Key.shift").when(k % 6 != 1, F.chr((k % 26 + 97).cast("bigint"))).alias("key"), (k % 8 == 0).alias("double_click"),
    )
    return rows.withColumn("monitor", monitor.cast(MONITOR)).withColumn("details", details).withColumn("cursor_position", F.array((k * 17).cast("double"), (k * 7).cast("double")))


ACTED_SQL = BLOCKS_SQL + """,
    m AS (SELECT *, CASE monitor_index WHEN 0 THEN 0 ELSE 1000 END AS ml, CASE monitor_index WHEN 0 THEN 0 ELSE 100 END AS mt,
                 CASE monitor_index WHEN 0 THEN 1000 ELSE 640 END AS mw, CASE monitor_index WHEN 0 THEN 500 ELSE 480 END AS mh FROM o),
    a AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'shift' WHEN k % 6 = 1 THEN 'unknown' ELSE chr(k % 26 + 97) END AS key,
                 '(' || CAST(round_even((k * 17 - ml) / mw * 1000, 0) AS BIGINT) || ', ' || CAST(round_even((k * 7 - mt) / mh * 1000, 0) AS BIGINT) || ')' AS place,
                 trim(CASE WHEN k % 3 - 1 > 0 THEN 'up' WHEN k % 3 - 1 < 0 THEN 'down' ELSE '' END || ' ' || CASE WHEN k % 2 > 0 THEN 'right' ELSE '' END) AS way,
                 CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY session_id ORDER BY position) THEN 1 ELSE 0 END AS new FROM m),
    z AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY position) AS run,
                 CASE WHEN event_type IN ('mouse_down', 'mouse_scroll', 'mouse_move') AND new = 1 THEN 1 ELSE 0 END AS flush FROM a),
    y AS (SELECT *, sum(flush) OVER (PARTITION BY session_id ORDER BY position) AS after FROM z),
    keyed AS (SELECT session_id, after, string_agg(key, '|' ORDER BY position) AS keys, count(*) AS n FROM y WHERE event_type = 'key_press' GROUP BY ALL),
    said AS (SELECT q.session_id, coalesce(e.position - 0.5, 1e9) AS pos,
                    CASE WHEN e.event_type = 'mouse_down' THEN 'Key(s) pressed: ' WHEN n = 1 THEN 'Key pressed: ' ELSE 'Keys pressed: ' END || keys AS action
             FROM keyed q LEFT JOIN (SELECT * FROM y WHERE flush = 1) e ON q.session_id = e.session_id AND q.after = e.after - 1),
    clicks AS (SELECT session_id, position AS pos, 'Mouse clicked ' || CASE WHEN k % 4 = 0 THEN 'right' ELSE 'left' END || ' at ' || place || CASE WHEN k % 8 = 0 THEN ' (double click)' ELSE '' END AS action
               FROM y WHERE event_type = 'mouse_down'),
    ran AS (SELECT session_id, min(position) AS pos, CASE WHEN any_value(event_type) = 'mouse_scroll' THEN 'Scrolled ' || CASE WHEN arg_min(way, position) = '' THEN 'no scroll' ELSE arg_min(way, position) END
                   WHEN count(*) > 1 THEN 'Mouse moved from ' || arg_min(place, position) || ' to ' || arg_max(place, position) ELSE 'Mouse moved to ' || arg_min(place, position) END AS action
            FROM y WHERE event_type IN ('mouse_scroll', 'mouse_move') GROUP BY session_id, run),
    every AS (SELECT * FROM said UNION ALL SELECT * FROM clicks UNION ALL SELECT * FROM ran)"""


@query("key_flush_groups", f"WITH {ACTED_SQL} SELECT session_id, CAST(after AS BIGINT) AS after_flushes, keys, n FROM keyed")
def key_flush_groups(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = labeling.reordered(_acted(spark, sf_dir), ["session_id"], ["ts", "event_id"])
    w = Window.partitionBy("session_id").orderBy("position")
    new = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))
    rows = rows.withColumn("flush", (new & F.col("event_type").isin("mouse_down", "mouse_scroll", "mouse_move")).cast("int"))
    rows = rows.withColumn("after_flushes", F.sum("flush").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = text.key_name(F.coalesce("details.key", F.lit("Key.unknown")))
    keyed = rows.where("event_type = 'key_press'").groupBy("session_id", "after_flushes").agg(F.array_sort(F.collect_list(F.struct("position", key.alias("key")))).alias("x"))
    return keyed.select("session_id", "after_flushes", F.array_join(F.transform("x", lambda x: x["key"]), "|").alias("keys"), F.size("x").cast("bigint").alias("n"))


@query("prompt_actions", f"WITH {ACTED_SQL} SELECT session_id, string_agg(action, chr(10) ORDER BY pos) AS actions FROM every GROUP BY session_id")
def prompt_actions(spark, sf_dir) -> DataFrame:
    lines = labeling.actions(_acted(spark, sf_dir), ["session_id"], ["ts", "event_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "action"))), lambda x: x["action"]), "\n")
    return lines.groupBy("session_id").agg(joined.alias("actions"))


@query(
    "prompt_text",
    f"""WITH {ACTED_SQL}, t AS (SELECT session_id, string_agg(action, chr(10) || chr(9) ORDER BY pos) AS said FROM every GROUP BY session_id),
        e AS (SELECT session_id, count(*) AS n, arg_min(place, ts) AS a, arg_max(place, ts) AS b FROM y GROUP BY session_id)
        SELECT session_id, chr(10) || '    00:05 Event:' || chr(10) || '    ' ||
               CASE WHEN n > 1 THEN 'Cursor positions: ' || a || ' to ' || b ELSE 'Cursor position: ' || a END || chr(10) || '    Actions:' || chr(10) || '    ' ||
               coalesce(chr(9) || said, 'No actions recorded.') || chr(10) || '        ' AS prompt
        FROM e LEFT JOIN t USING (session_id)""",
)
def prompt_text(spark, sf_dir) -> DataFrame:
    return labeling.prompts(_acted(spark, sf_dir), ["session_id"], ["ts", "event_id"], F.lit("00:05"))


@query("rel_coords", f"WITH {ACTED_SQL} SELECT event_id, place FROM y")
def rel_coords(spark, sf_dir) -> DataFrame:
    return _acted(spark, sf_dir).select("event_id", geometry.per_mille(F.col("cursor_position"), F.col("monitor")).alias("place"))


@query("scroll_direction", f"WITH {ACTED_SQL} SELECT event_id, CASE WHEN way = '' THEN 'no scroll' ELSE way END AS way FROM y")
def scroll_direction(spark, sf_dir) -> DataFrame:
    return _acted(spark, sf_dir).select("event_id", text.scroll_direction(F.col("details.dx"), F.col("details.dy")).alias("way"))


@query("mmss_roundtrip", f"WITH {EVENTS_SQL} SELECT event_id, format('{{:02d}}:{{:02d}}', k * 77 // 60, k * 77 % 60) AS clock, k * 77 AS seconds FROM ev")
def mmss_roundtrip(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", timefmt.clock(F.col("k") * 77).alias("clock"))
    return rows.withColumn("seconds", timefmt.clock_seconds(F.col("clock")))


@query(
    "image_coords",
    f"""WITH {ACTED_SQL} SELECT event_id, CAST(trunc((k * 17 - ml) * 0.5) AS INTEGER) AS x, CAST(trunc((k * 7 - mt) * 0.5) AS INTEGER) AS y,
        k * 17 >= ml AND k * 17 < ml + mw AND k * 7 >= mt AND k * 7 < mt + mh AS on_monitor FROM y""",
)
def image_coords(spark, sf_dir) -> DataFrame:
    rows = _acted(spark, sf_dir)
    px, py = F.get("cursor_position", F.lit(0)), F.get("cursor_position", F.lit(1))
    x, y = geometry.to_image(px, py, F.col("monitor"), F.lit(0.5))
    return rows.select("event_id", x.alias("x"), y.alias("y"), geometry.inside(px, py, F.col("monitor")).alias("on_monitor"))


ROWS_SQL = EVENTS_SQL + "," + CAPTIONS_SQL + """,
    rn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS i FROM ev),
    sz AS (SELECT session_id, count(*) AS n FROM rn GROUP BY 1),
    ma AS (SELECT c.*, n, CAST(greatest(0, least(start_seconds, n - 1)) AS INTEGER) AS start_index FROM cap c JOIN sz USING (session_id)),
    mb AS (SELECT *, CAST(greatest(start_index, least(end_seconds, n - 1)) AS INTEGER) AS end_index FROM ma)"""


def _caption_rows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir)


@query("caption_match_raw", f"WITH {ROWS_SQL} SELECT session_id, turn, caption, start_index, end_index, end_index - start_index + 1 AS n_rows FROM mb")
def caption_match_raw(spark, sf_dir) -> DataFrame:
    out = labeling.match_captions(captions(spark, sf_dir), _caption_rows(spark, sf_dir), "session_id", ["ts", "event_id"], ["start_seconds", "turn"], attach_tail=False)
    return out.select("session_id", "turn", "caption", "start_index", "end_index", "n_rows")


@query(
    "caption_tail_attach",
    f"""WITH {ROWS_SQL}, lastc AS (SELECT session_id, arg_max(turn, turn) AS turn, arg_max(end_index, turn) AS e, any_value(n) AS n FROM mb GROUP BY session_id),
        fre AS (SELECT l.session_id, l.turn, l.n, count(*) AS free FROM lastc l JOIN rn USING (session_id)
                WHERE i > e AND NOT EXISTS (SELECT 1 FROM mb WHERE mb.session_id = l.session_id AND i BETWEEN mb.start_index AND mb.end_index) GROUP BY ALL)
        SELECT m.session_id, m.turn, m.start_index, CAST(CASE WHEN free > 0 THEN f.n - 1 ELSE end_index END AS INTEGER) AS end_index,
               CAST(end_index - start_index + 1 + coalesce(free, 0) AS INTEGER) AS n_rows
        FROM mb m LEFT JOIN fre f ON m.session_id = f.session_id AND m.turn = f.turn""",
)
def caption_tail_attach(spark, sf_dir) -> DataFrame:
    out = labeling.match_captions(captions(spark, sf_dir), _caption_rows(spark, sf_dir), "session_id", ["ts", "event_id"], ["start_seconds", "turn"])
    return out.select("session_id", "turn", "start_index", "end_index", "n_rows")


@query(
    "caption_match",
    f"""WITH {ROWS_SQL} SELECT m.session_id, turn, count(*) AS num_aggregations, min(r.ts) AS start_ts, max(r.ts) AS end_ts, arg_min(r.event_id, i) AS img
        FROM mb m JOIN rn r ON m.session_id = r.session_id AND r.i BETWEEN m.start_index AND m.end_index GROUP BY ALL""",
)
def caption_match(spark, sf_dir) -> DataFrame:
    rows = _caption_rows(spark, sf_dir)
    found = labeling.match_captions(captions(spark, sf_dir), rows, "session_id", ["ts", "event_id"], ["start_seconds", "turn"], attach_tail=False)
    ends = labeling.matched_ends(found, rows, "session_id", ["ts", "event_id"], ["event_id", "ts"])
    return ends.select("session_id", "turn", F.col("n_rows").cast("bigint").alias("num_aggregations"), F.col("first_ts").alias("start_ts"), F.col("last_ts").alias("end_ts"), F.col("first_event_id").alias("img"))


@query(
    "caption_rows",
    f"""WITH {ROWS_SQL} SELECT m.session_id, turn, r.event_id, CAST(r.i AS INTEGER) AS row_index
        FROM mb m JOIN rn r ON m.session_id = r.session_id AND r.i BETWEEN m.start_index AND m.end_index""",
)
def caption_rows(spark, sf_dir) -> DataFrame:
    """Every event that each caption covers."""
    rows = _caption_rows(spark, sf_dir)
    found = labeling.match_captions(captions(spark, sf_dir), rows, "session_id", ["ts", "event_id"], ["start_seconds", "turn"], attach_tail=False)
    return labeling.matched_rows(found, rows, "session_id", ["ts", "event_id"], ["event_id"]).select("session_id", "turn", "event_id", F.col("row_index").cast("int").alias("row_index"))


@query("captions_per_session", f"WITH {CAPTIONS_SQL} SELECT session_id, count(*) AS n_captions FROM cap GROUP BY session_id")
def captions_per_session(spark, sf_dir) -> DataFrame:
    return labeling.captions_of_sessions(captions(spark, sf_dir), "session_id")


@query(
    "caption_parse",
    """SELECT conv_id, turn, CAST(turn * 60 + CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS BIGINT) AS start_seconds,
              CAST(turn * 60 + CASE WHEN turn % 2 = 0 THEN turn + 1 WHEN turn % 3 = 0 THEN 0 ELSE turn END AS BIGINT) AS end_seconds, role AS caption FROM conversations WHERE turn % 5 <> 4""",
)
def caption_parse(spark, sf_dir) -> DataFrame:
    """A stand-in for a model answers with one caption for each turn; some of its times are bad."""
    turn = F.col("turn")
    item = F.struct(
        F.when(turn % 3 == 0, "bad").otherwise(timefmt.clock(turn)).alias("start"), F.when(turn % 2 == 0, timefmt.clock(turn + 1)).otherwise("1:2:3").alias("end"),
        F.when(turn % 2 == 0, F.col("role")).alias("caption"), F.col("role").alias("description"),
    )
    answer = F.when(turn % 5 == 4, F.lit('{"error": "none"}')).otherwise(F.to_json(F.array(item)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), (turn * 60).alias("at"))
    return labeling.parsed_captions(rows, "answer", "at", ["conv_id", "turn"]).drop("position")


@query(
    "dedupe_last_kept",
    f"""WITH RECURSIVE {EVENTS_SQL}, seq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM ev),
        fold AS (SELECT session_id, rn, event_id, k AS last, true AS kept FROM seq WHERE rn = 1
                 UNION ALL
                 SELECT s.session_id, s.rn, s.event_id, CASE WHEN bit_count(xor(s.k, f.last)) > 1 THEN s.k ELSE f.last END, bit_count(xor(s.k, f.last)) > 1
                 FROM fold f JOIN seq s ON s.session_id = f.session_id AND s.rn = f.rn + 1)
        SELECT event_id FROM fold WHERE kept""",
)
def dedupe_last_kept(spark, sf_dir) -> DataFrame:
    return dedupe.keep_changed(events(spark, sf_dir), ["session_id"], ["ts", "event_id"], "k", 1).select("event_id")


@query("dedupe_in_parts", ORACLES["dedupe_last_kept"])
def dedupe_in_parts(spark, sf_dir) -> DataFrame:
    """As ``dedupe_last_kept``, for sessions too large for one task: six days at a time, folded again where the day before ends otherwise than was thought."""
    return segmented.keep_changed_in_parts(events(spark, sf_dir), ["session_id"], "ts", ["event_id"], "k", 6 * DAY).select("event_id")


@query("hamming_pairs", f"WITH {EVENTS_SQL} SELECT event_id, CAST(bit_count(xor(k, lag(k) OVER (PARTITION BY session_id ORDER BY ts, event_id))) AS INTEGER) AS bits FROM ev QUALIFY bits IS NOT NULL")
def hamming_pairs(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("k").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    rows = events(spark, sf_dir).withColumn("before", before).where("before is not null")
    return rows.select("event_id", text.hamming(F.col("k").cast("bigint"), F.col("before").cast("bigint")).alias("bits"))


STAMPED = "strftime(make_timestamp({}), '%Y-%m-%d_%H-%M-%S-%f')"
SHOTS_SQL = FRAMES_SQL + "," + CAPTIONS_SQL + """,
    nr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts, path) - 1 AS i FROM fr),
    ls AS (SELECT session_id, max(frame_ts) AS last_ts FROM fr GROUP BY 1),
    ex AS (SELECT c.session_id, c.turn, c.caption AS text, a.frame_ts AS s, coalesce(b.frame_ts, last_ts) AS e, a.path AS img
           FROM cap c JOIN nr a ON a.session_id = c.session_id AND a.i = c.start_seconds JOIN ls ON ls.session_id = c.session_id
           LEFT JOIN nr b ON b.session_id = c.session_id AND b.i = c.end_seconds + 1)"""


def _exported(spark, sf_dir) -> DataFrame:
    caps = captions(spark, sf_dir).select("session_id", "turn", timefmt.clock(F.col("start_seconds")).alias("start"), timefmt.clock(F.col("end_seconds")).alias("end"), "caption")
    shots = frames(spark, sf_dir).select("session_id", "path", ((F.col("frame_ts") + 0.25) / 1e6).alias("ts"))
    return dataset.from_captions(caps, shots, "session_id", ["turn"])


@query("dataset_format2", f"WITH {SHOTS_SQL} SELECT session_id, turn, text, {STAMPED.format('s')} AS start_time, {STAMPED.format('e')} AS end_time, img FROM ex")
def dataset_format2(spark, sf_dir) -> DataFrame:
    return _exported(spark, sf_dir)


@query(
    "split_ratio",
    f"""WITH {SHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ex)
        SELECT session_id, turn, CASE WHEN i <= floor(n * 0.5) THEN 'train' WHEN i <= floor(n * 0.5) + floor(n * 0.25) THEN 'test' ELSE 'validation' END AS split FROM r""",
)
def split_ratio(spark, sf_dir) -> DataFrame:
    return dataset.split_by_ratio(_exported(spark, sf_dir), ["session_id"], ["turn"], timefmt.split_spec("0.5,0.25,0.25")).select("session_id", "turn", "split")


@query(
    "split_time",
    f"""WITH {SHOTS_SQL}, r AS (SELECT *, row_number() OVER w AS i, first_value(s) OVER w AS f FROM ex WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
        c AS (SELECT session_id, coalesce(max(i) FILTER (WHERE s < f + {7 * DAY}), 0) AS a, coalesce(max(i) FILTER (WHERE s < f + {10 * DAY}), 0) AS b FROM r GROUP BY 1)
        SELECT session_id, turn, CASE WHEN i <= a THEN 'train' WHEN i <= b THEN 'test' ELSE 'validation' END AS split FROM r JOIN c USING (session_id)""",
)
def split_time(spark, sf_dir) -> DataFrame:
    rows = _exported(spark, sf_dir)
    return dataset.split_by_time(rows, ["session_id"], ["turn"], timefmt.unstamp(F.col("start_time")), timefmt.split_spec("1wk,3d,48hr")).select("session_id", "turn", "split")


def _segmented(spark, sf_dir) -> DataFrame:
    """A stand-in for a model puts turns into tasks: by thirds, some into two, some into none."""
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    ids = F.when(F.col("event_no") % 4 == 3, F.array().cast("array<string>")).when(F.col("event_no") % 5 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.when(F.col("event_no") % 2 == 0, "a").otherwise("b")))
    return rows.select("session_id", "event_no", ids.alias("task_ids"))


TASKS_SQL = CAPTIONS_SQL + """,
    nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS INTEGER) AS event_no FROM cap),
    ta AS (SELECT session_id, event_no, unnest(CASE WHEN event_no % 4 = 3 THEN [] WHEN event_no % 5 = 2 THEN ['a', 'b'] WHEN event_no % 2 = 0 THEN ['a'] ELSE ['b'] END) AS task_id FROM nu)"""


@query("task_groups", f"WITH {TASKS_SQL} SELECT session_id, task_id, count(*) AS n, string_agg(caption, '|' ORDER BY event_no) AS captions FROM ta JOIN nu USING (session_id, event_no) GROUP BY ALL")
def task_groups(spark, sf_dir) -> DataFrame:
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    found = tasks.grouped(_segmented(spark, sf_dir), rows, ["session_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_no", "caption"))), lambda x: x["caption"]), "|")
    return found.groupBy("session_id", "task_id").agg(F.count("*").alias("n"), joined.alias("captions"))


@query("noise_events", f"WITH {TASKS_SQL} SELECT session_id, event_no, caption FROM nu ANTI JOIN ta USING (session_id, event_no)")
def noise_events(spark, sf_dir) -> DataFrame:
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    return tasks.noise(rows, tasks.grouped(_segmented(spark, sf_dir), rows, ["session_id"]), ["session_id", "event_no"]).select("session_id", "event_no", "caption")


@query("transcript", f"WITH {TASKS_SQL} SELECT session_id, string_agg('[ID: ' || event_no || ' | Time: ' || format('{{:02d}}:{{:02d}}', start_seconds // 60, start_seconds % 60) || '] ' || caption, chr(10) ORDER BY event_no) AS transcript FROM nu GROUP BY 1")
def transcript(spark, sf_dir) -> DataFrame:
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    return tasks.transcripts(rows, ["session_id"], "event_no", "start_seconds", "caption")


@query("sanitized_captions", f"WITH {TASKS_SQL} SELECT session_id, event_no, CASE WHEN event_no % 3 = 1 THEN '[removed]' ELSE caption END AS caption FROM nu")
def sanitized_captions(spark, sf_dir) -> DataFrame:
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    changes = rows.where("event_no % 3 = 1").select("session_id", "event_no", F.lit("[removed]").alias("caption"))
    return tasks.overwritten(rows, changes, ["session_id", "event_no"], "caption").select("session_id", "event_no", "caption")


@query(
    "coarse_types",
    f"WITH {EVENTS_SQL} SELECT event_type, CASE event_type WHEN 'mouse_down' THEN 'click' WHEN 'mouse_move' THEN 'move' WHEN 'mouse_scroll' THEN 'scroll' ELSE 'key' END AS coarse, count(*) AS n FROM ev GROUP BY ALL",
)
def coarse_types(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", text.coarse(F.col("event_type")).alias("coarse"), "n")
