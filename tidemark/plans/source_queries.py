"""Queries on readers, writers, streams and model calls: what is written is read back, what streams is compared with the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, timefmt
from tidemark.operators import dedupe, labeling, models, tasks
from tidemark.plans.label_queries import TASKS_SQL
from tidemark.plans.mapping import BURSTS_SQL, CAPTIONS_SQL, DAY, EVENTS_SQL, FRAMES_SQL, GAP_US, TOTALS_US, captions, events, frames, table
from tidemark.plans.record_queries import BOUNDS_SQL
from tidemark.plans.registry import query
from tidemark.schemas import AGGREGATION
from tidemark.sources import logs, sessions, sinks, store
from tidemark.streaming import live

COARSE_SQL = "CASE event_type WHEN 'mouse_down' THEN 'click' WHEN 'mouse_move' THEN 'move' WHEN 'mouse_scroll' THEN 'scroll' ELSE 'key' END"


@query("event_log", f"WITH {EVENTS_SQL} SELECT event_id, ts / 1e6 AS timestamp, event_type, {COARSE_SQL} AS coarse_type, monitor_index FROM ev")
def event_log(spark, sf_dir) -> DataFrame:
    """Events written as lines, odd ones as Python literals, some blank or broken lines between, and read back."""
    rows = events(spark, sf_dir)
    record = F.struct((F.col("ts") / 1e6).alias("timestamp"), "monitor_index", "event_type", F.struct(F.col("event_id").cast("double").alias("x")).alias("details"))
    js = F.to_json(record)
    literal = F.concat(F.lit("{'event_type': '"), "event_type", F.lit("', 'monitor_index': "), "monitor_index", F.lit(", 'cursor_position': None, 'timestamp': "), (F.col("ts") / 1e6).cast("string"), F.lit(", 'details': {'x': "), F.col("event_id").cast("double").cast("string"), F.lit("}}"))
    line = F.when(F.col("event_id") % 2 == 0, js).otherwise(literal)
    path = sinks.scratch(spark, "events") + "/log"
    rows.select(F.explode(F.when(F.col("event_id") % 50 == 0, F.array(line, F.lit("  "), F.lit("{'broken': "))).otherwise(F.array(line))).alias("value")).write.text(path)
    return logs.read_events(spark, path).select(F.col("details.x").cast("bigint").alias("event_id"), "timestamp", "event_type", "coarse_type", "monitor_index")


@query("aggregation_log", f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 3 = 0 THEN (ts + 1000000) / 1e6 ELSE ts / 1e6 END AS timestamp, event_type, 1 + k % 2 AS num_events FROM ev")
def aggregation_log(spark, sf_dir) -> DataFrame:
    """Aggregations added to a log in two runs; the time of a frame, where one has it, is its time."""
    rows = events(spark, sf_dir)
    records = rows.select("event_id", (F.col("ts") / 1e6).alias("timestamp"), "event_type", (1 + F.col("k") % 2).alias("num_events"), F.col("event_id").alias("burst_id"), F.when(F.col("k") % 3 == 0, (F.col("ts") + 1_000_000) / 1e6).alias("screenshot_timestamp"))
    path = sinks.scratch(spark, "aggregations") + "/log"
    for part in (0, 1):
        sinks.append_json(records.where(F.col("event_id") % 2 == part).drop("event_id"), path)
    assert "burst_id" in AGGREGATION
    return logs.read_aggregations(spark, path).select(F.col("burst_id").alias("event_id"), "timestamp", "event_type", "num_events")


def _put(spark, paths: list[str]) -> None:
    """Files of one byte: a few, for each of the 25 nations, of which there are as many at any scale."""
    sc = spark.sparkContext
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
        out.writeByte(1)
        out.close()


def _folders(spark, sf_dir) -> str:
    """A folder for each nation, with some of the files that a session may have."""
    root = sinks.scratch(spark, "sessions") + "/rec"
    paths = []
    for (n,) in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect():
        paths += [f"{root}/s{n}/screenshots/{n}.{i}5_reason_x.{'jpg' if i else 'PNG'}" for i in range(n % 4)]
        paths += [f"{root}/s{n}/{f}" for f, has in (("aggregations.jsonl", n % 3), ("data.jsonl", n % 5 == 0), (f"{n}.5.png", n % 7 == 0)) if has]
    _put(spark, paths)
    return root


@query(
    "found_sessions",
    """WITH s AS (SELECT 's' || n_nationkey AS session_id, n_nationkey % 3 <> 0 AS agg, n_nationkey % 5 = 0 AS done, n_nationkey % 4 AS shots, n_nationkey % 4 + CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END AS pics FROM nation)
       SELECT 'all' AS how, session_id, CAST(shots AS BIGINT) AS n_screenshots FROM s WHERE agg AND shots > 0
       UNION ALL SELECT 'new', session_id, shots FROM s WHERE agg AND shots > 0 AND NOT done
       UNION ALL SELECT 'pictures', session_id, CASE WHEN shots > 0 THEN shots ELSE pics END FROM s WHERE pics > 0""",
)
def found_sessions(spark, sf_dir) -> DataFrame:
    root = _folders(spark, sf_dir)
    found = {"all": sessions.discover(spark, root), "new": sessions.discover(spark, root, skip_existing=True), "pictures": sessions.discover_pictures(spark, root)}
    parts = [df.select(F.lit(how).alias("how"), "session_id", F.col("n_screenshots").cast("bigint").alias("n_screenshots")) for how, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("listed_screenshots", "SELECT n_nationkey + i / 10.0 + 0.05 AS ts, CAST(row_number() OVER (ORDER BY n_nationkey, i) - 1 AS INTEGER) AS position FROM nation, range(1, 4) r(i)")
def listed_screenshots(spark, sf_dir) -> DataFrame:
    """Pictures of one folder in the order of the times in their names; other files there don't count."""
    folder = sinks.scratch(spark, "shots") + "/screenshots"
    keys = [n for (n,) in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    _put(spark, [f"{folder}/{n}.{i}5_reason_x.{'png' if i == 2 else 'jpg'}" for n in keys for i in (1, 2, 3)] + [f"{folder}/{n}.05.txt" for n in keys] + [f"{folder}/none.jpg"])
    return logs.list_screenshots(spark, folder).select("ts", "position")


@query("resolved_pictures", f"WITH {FRAMES_SQL} SELECT frame_id, CASE WHEN hash % 3 = 0 THEN 'direct' WHEN hash % 3 = 1 THEN 'beside' ELSE 'gone' END AS how FROM fr WHERE hash % 10 <> 0")
def resolved_pictures(spark, sf_dir) -> DataFrame:
    """Rows whose picture is there as named, or in the session's screenshots, or not at all; rows without one are left out."""
    rows = frames(spark, sf_dir).withColumn("img", F.when(F.col("hash") % 10 == 0, "").otherwise(F.concat(F.lit("d/"), F.col("frame_id").cast("string"), F.lit(".jpg"))))
    beside = F.concat(F.lit("root/"), F.col("session_id").cast("string"))
    there = rows.where(F.col("hash") % 3 != 2).select(F.when(F.col("hash") % 3 == 0, F.col("img")).otherwise(F.concat(beside, F.lit("/screenshots/"), F.col("frame_id").cast("string"), F.lit(".jpg"))).alias("path"))
    out = logs.resolve_pictures(logs.rows_with_pictures(rows), there, "img", beside)
    how = F.when(F.col("resolved").isNull(), "gone").when(F.col("resolved") == F.col("img"), "direct").otherwise("beside")
    return out.select("frame_id", how.alias("how"))


@query("cached_hashes", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN -CAST(s_suppkey AS BIGINT) ELSE CAST(s_suppkey AS BIGINT) END ELSE 0 END AS hash FROM supplier")
def cached_hashes(spark, sf_dir) -> DataFrame:
    """A cache of unsigned hashes written as JSON documents, read as longs of the same bits, and looked up by the end of a path."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("a/b/"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("key"))
    value = F.when(F.col("s_suppkey") % 2 == 0, F.lit(str(2**64)).cast("decimal(20,0)") - F.col("s_suppkey")).otherwise(F.col("s_suppkey").cast("decimal(20,0)"))
    path = sinks.scratch(spark, "hashes") + "/cache"
    sinks.write_hashes(rows.where(F.col("s_suppkey") % 4 != 0).select("key", value.alias("hash_int")), path)
    found = dedupe.with_hashes(rows.withColumn("path", F.concat(F.lit("/x/y/"), "key")), logs.read_hashes(spark, path), "path")
    return found.select("s_suppkey", F.coalesce("hash", F.lit(0)).alias("hash"))


@query("chunk_results", f"WITH {CAPTIONS_SQL} SELECT session_id, turn % 3 AS chunk_index, turn, CASE WHEN turn % 3 = 1 THEN 'again' ELSE caption END AS caption FROM cap WHERE caption IS NOT NULL")
def chunk_results(spark, sf_dir) -> DataFrame:
    """Results kept by session and chunk; one chunk of each is written anew, the others stay."""
    rows = captions(spark, sf_dir).where("caption is not null").select("session_id", (F.col("turn") % 3).alias("chunk_index"), "turn", "caption")
    kept = store.ChunkStore(spark, sinks.scratch(spark, "chunks") + "/kept", ["session_id", "chunk_index"])
    kept.upsert(rows)
    kept.upsert(rows.where("chunk_index = 1").withColumn("caption", F.lit("again")))
    return kept.read().select("session_id", "chunk_index", "turn", "caption")


@query("kept_dataset", f"WITH {FRAMES_SQL} SELECT CASE WHEN hash % 5 = 0 THEN 'test' ELSE 'train' END AS split, session_id, count(*) AS n, max(path) AS last FROM fr GROUP BY ALL")
def kept_dataset(spark, sf_dir) -> DataFrame:
    path = sinks.scratch(spark, "dataset") + "/kept"
    sinks.write_dataset(frames(spark, sf_dir).withColumn("split", F.when(F.col("hash") % 5 == 0, "test").otherwise("train")), path)
    return spark.read.parquet(path).groupBy("split", "session_id").agg(F.count("*").alias("n"), F.max("path").alias("last"))


@query(
    "model_captions",
    f"""WITH {CAPTIONS_SQL}, todo AS (SELECT *, 'say ' || CASE WHEN turn % 4 = 3 THEN 'FAIL' ELSE 'it' END || turn AS prompt FROM cap WHERE turn % 5 <> 0)
        SELECT session_id, turn, 'earlier' AS caption FROM cap WHERE turn % 5 = 0
        UNION ALL SELECT session_id, turn, length(prompt) || ' characters' FROM todo WHERE turn % 4 <> 3""",
)
def model_captions(spark, sf_dir) -> DataFrame:
    """Chunks without a result go to a model; failed ones stay out, earlier results stay in."""
    chunks = captions(spark, sf_dir).select("session_id", "turn", F.concat(F.lit("say "), F.when(F.col("turn") % 4 == 3, "FAIL").otherwise("it"), F.col("turn").cast("string")).alias("prompt"))
    done = chunks.where("turn % 5 = 0").select("session_id", "turn", F.lit("earlier").alias("caption"))
    told = models.answers(models.pending(chunks, done, ["session_id", "turn"]), lambda: models.client("fixed"), parallel=4)
    said = labeling.parsed_captions(told.where("error is null").withColumn("at", F.lit(0)), "answer", "at", ["session_id", "turn"])
    return done.unionByName(said.select("session_id", "turn", "caption"))


@query("model_tasks", f"""WITH {TASKS_SQL}, g AS (SELECT session_id, event_no, unnest(CASE WHEN event_no % 3 = 0 THEN ['odd_even', 'all'] ELSE ['odd_even'] END) AS w FROM nu),
        t AS (SELECT session_id, event_no, CASE WHEN w = 'all' THEN 'all' WHEN event_no % 2 = 1 THEN 'odd' ELSE 'even' END AS task_id FROM g),
        n AS (SELECT session_id, task_id, count(*) || ' steps' AS task_caption FROM t GROUP BY ALL)
        SELECT session_id, task_id, task_caption, event_no, 'event ' || event_no AS caption FROM t JOIN n USING (session_id, task_id) WHERE event_no % 2 = 0""")  # fmt: skip
def model_tasks(spark, sf_dir) -> DataFrame:
    """Captions cleaned by a model, put into tasks by it, and each task described and freed of events that don't matter."""
    make = lambda: models.client("listing")
    rows = tasks.numbered(captions(spark, sf_dir), ["session_id"], ["turn"])
    told = tasks.transcripts(rows.withColumn("caption", F.lit("said")), ["session_id"], "event_no", "start_seconds", "caption")
    clean = tasks.overwritten(rows, models.clean_captions(told, make, ["session_id"]), ["session_id", "event_no"], "caption")
    grouped = tasks.grouped(models.segment_tasks(told, make, ["session_id"]), clean, ["session_id"])
    chosen = models.describe_tasks(grouped, make, ["session_id"])
    return grouped.join(chosen, ["session_id", "task_id", "event_no"]).select("session_id", "task_id", "task_caption", "event_no", "caption")


def _streamed(spark, rows: DataFrame, label: str) -> DataFrame:
    """A table as a stream of files."""
    folder = sinks.scratch(spark, label) + "/in"
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def _landed(spark, stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives until its input ends."""
    folder = sinks.scratch(spark, label)
    sinks.stream_to_json(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).json(f"{folder}/out")


LATE_US = 3_000_000


@query(
    "streamed_boundaries",
    f"""{BOUNDS_SQL}, last AS (SELECT max(ts) - {LATE_US} AS mark FROM ev), own AS (SELECT session_id, category, max(ts) AS newest FROM ev GROUP BY ALL)
        SELECT session_id, category, request_state, reason, ts, event_id FROM bounds JOIN own USING (session_id, category), last
        WHERE request_state <> 'end' OR ts < newest OR ts + {GAP_US} < mark""",
)
def streamed_boundaries(spark, sf_dir) -> DataFrame:
    """Boundaries of a stream: those of the batch, but for the ends of bursts that the watermark hasn't passed when the input ends."""
    rows = events(spark, sf_dir).select("session_id", "category", "ts", "event_id", "monitor_index", F.timestamp_micros("ts").alias("event_time"))
    gaps = {c: GAP_US for c in TOTALS_US}
    out = _landed(spark, live.stream_boundaries(_streamed(spark, rows, "live"), gaps, TOTALS_US), "boundaries")
    return out.select("session_id", "category", "request_state", "reason", "ts", "event_id")


@query(
    "streamed_links",
    f"""WITH {BURSTS_SQL} SELECT session_id, category, start_ts AS ts, first_event AS event_id,
        coalesce(lead(start_ts) OVER (PARTITION BY session_id ORDER BY start_ts, first_event), (SELECT max(ts) + 1 FROM ev)) AS end_ts FROM ids""",
)
def streamed_links(spark, sf_dir) -> DataFrame:
    """Starts of bursts linked while they stream, and the rest at shutdown: together every one once."""
    from tidemark.operators import bursts

    starts = bursts.summaries(bursts.with_bursts(events(spark, sf_dir), GAP_US))
    rows = starts.select("session_id", "category", F.col("burst_id").cast("string").alias("burst_id"), F.lit("start").alias("request_state"), F.col("start_ts").alias("ts"), F.col("first_event").alias("event_id"))
    live.with_rocksdb(spark)
    emitted = _landed(spark, live.stream_links(_streamed(spark, rows, "requests")), "links")
    now = events(spark, sf_dir).agg(F.max("ts") + 1).first()[0]
    whole = emitted.select("session_id", "category", "ts", "event_id", "end_ts").unionByName(live.flushed_links(rows, emitted, now).select("session_id", "category", "ts", "event_id", "end_ts"))
    return whole


@query("streamed_frames", f"WITH {FRAMES_SQL} SELECT e.event_id, coalesce(f.frame_id, -1) AS frame_id FROM (SELECT * FROM ev WHERE category <> 'move') e ASOF LEFT JOIN (SELECT session_id, max(frame_id) AS frame_id, frame_ts FROM fr GROUP BY ALL) f ON e.session_id = f.session_id AND e.ts - {DAY} >= f.frame_ts")
def streamed_frames(spark, sf_dir) -> DataFrame:
    """The last frame at least a day older than each event, from a ring that holds all of a session's frames here."""
    rows = events(spark, sf_dir)
    both = rows.select("session_id", "ts", F.when(F.col("category") != "move", F.col("event_id")).alias("event_id"), F.when(F.col("category") == "move", F.col("event_id")).alias("frame_id"))
    stream = _streamed(spark, both, "both")
    out = _landed(spark, live.stream_frames(stream.where("event_id is not null"), stream.where("frame_id is not null"), 100_000, DAY), "ring")
    return out.select("event_id", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"))


@query(
    "more_functions",
    f"""WITH {FRAMES_SQL} SELECT frame_id, hash / 10.0 AS loose, CASE WHEN hash % 2 = 0 THEN hash / 10.0 END AS listed, CAST(ceil(hash / 7.0) AS BIGINT) AS n_chunks, hash % 3 = 0 AS scrolls, hash % 3 = 1 AS moves,
        CAST(hash * 250000 AS BIGINT) AS us FROM fr""",
)
def more_functions(spark, sf_dir) -> DataFrame:
    rows, h = frames(spark, sf_dir), F.col("hash")
    tenth = F.format_string("%.1f", h / 10)
    kind = F.when(h % 3 == 0, "mouse_scroll").when(h % 3 == 1, "mouse_move").otherwise("key_press")
    named = F.when(h % 2 == 0, F.concat(F.lit("x"), tenth, F.lit("_a.jpg"))).otherwise("plain.jpg")
    loose = timefmt.loose_time(F.concat(F.lit("d/9.9/x"), F.when(h % 2 == 0, tenth).otherwise("none"), F.lit(".jpg")), h / 10)
    return rows.select("frame_id", loose.alias("loose"), timefmt.listing_time(named).alias("listed"), timefmt.num_chunks(h.cast("double"), 7).alias("n_chunks"), text.is_scroll(kind).alias("scrolls"), text.is_move(kind).alias("moves"), timefmt.micros(h / 4).alias("us"))
