"""Bursts while they happen, and the segments a live view shows."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.bursts import STALE, OpenBurst
from tidemark.operators.temporal import link_next
from tidemark.schemas import EMISSION_DELAY


def segments(requests: DataFrame, session: str = "session_id", burst: str = "burst_id", category: str = "category", ts: str = "ts", state: str = "request_state", tie: str = "event_id") -> DataFrame:
    """Stretches between the boundaries of each burst: ``start_ts`` to ``end_ts``.

    A start opens one, a middle closes it and opens the next, an end closes it.
    An end without a start gives a stretch of no length, a middle none.
    """
    place = F.when(F.col(state) == "start", 0).when(F.col(state) == "mid", 1).otherwise(2)
    before = F.lag(ts).over(Window.partitionBy(session, burst).orderBy(ts, place, tie))
    rows = requests.withColumn("start_ts", before).where((F.col(state) != "start") & (F.col("start_ts").isNotNull() | (F.col(state) == "end")))
    return rows.select(session, burst, category, F.coalesce("start_ts", ts).alias("start_ts"), F.col(ts).alias("end_ts"))


STATE = "bursts string"
BOUNDARY = "session_id long, category string, burst_id string, request_state string, reason string, ts long, event_id long, monitor_index int"


def stream_boundaries(events: DataFrame, gaps: dict[str, int], totals: dict[str, int], late: str = "3 seconds") -> DataFrame:
    """Starts, splits and ends of bursts of a stream, as they become known.

    ``events``: ``session_id``, ``category``, ``ts`` (microseconds),
    ``event_id``, ``monitor_index`` and ``event_time`` (a timestamp). State is
    kept by session: what is open of one burst of each category. A burst ends when
    the next event is further than its gap, or when the watermark passes its
    last event by the gap. Its id is its category and first time, so that no
    counter is shared. Events of a batch are taken in time order.
    """

    names = [f.split()[0] for f in BOUNDARY.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (session,), out = key, []
        bursts = json.loads(state.get[0]) if state.exists else {}  # by category: what is open, its first and its last time

        def said(category: str, begun: int, kind: str, reason: str, ts: int, monitor: int, event: int) -> None:
            out.append((session, category, f"{category}_{begun}", kind, reason, ts, event, monitor))

        if not state.hasTimedOut:
            rows, opened = [], {}
            for b in batches:
                rows += zip(*(b[c].tolist() for c in ("ts", "event_id", "monitor_index", "category")), strict=True)
            for ts, event, monitor, category in sorted(rows):
                if category not in opened:
                    queue, begun, _ = bursts.get(category, ([], None, None))
                    opened[category] = [OpenBurst(totals[category], [tuple(q) for q in queue]), begun, None]
                one = opened[category]
                burst = one[0]
                if burst.queue and ts - burst.queue[-1][0] > gaps[category]:
                    said(category, one[1], "end", STALE, *burst.queue[-1])
                    burst.queue.clear()
                if not burst.queue:
                    one[1] = ts
                    said(category, ts, "start", STALE, ts, monitor, event)
                if found := burst.push(ts, monitor, event):
                    said(category, one[1], "mid", *found)
                one[2] = ts
            bursts |= {c: (burst.queue, begun, last) for c, (burst, begun, last) in opened.items()}
        mark = state.getCurrentWatermarkMs()
        times = {c: (last + gaps[c]) // 1000 + 1 for c, (_, _, last) in bursts.items()}
        for category in [c for c, t in times.items() if t < mark]:
            queue, begun, _ = bursts.pop(category)
            said(category, begun, "end", STALE, *queue[-1])
        if bursts:
            state.update((json.dumps(bursts),))
            state.setTimeoutTimestamp(max(min(times[c] for c in bursts), mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    marked = events.withWatermark("event_time", late)
    return marked.groupBy("session_id").applyInPandasWithState(step, BOUNDARY, STATE, "append", GroupStateTimeout.EventTimeTimeout)


LINKED = "session_id long, category string, burst_id string, request_state string, ts long, event_id long, end_ts long"


def ready_requests(requests: DataFrame, needs_frame: str = "needs_screenshot", frame: str = "screenshot_path") -> DataFrame:
    """``requests`` with ``ready``: whether a boundary that waits for its frame has it; one that needs none is ready."""
    return requests.withColumn("ready", ~F.coalesce(F.col(needs_frame), F.lit(False)) | F.col(frame).isNotNull())


class Links(StatefulProcessor):
    """One session's boundaries on their way: those held, and the ``open`` one that waits for its next.

    Few are held in one value, ``near``; beyond ``BLOCK`` they go, sorted, into
    blocks of so many. A session has one timer, at its earliest boundary: it takes
    what the watermark has passed from ``near`` and from the blocks that begin before it.
    So a session costs a few calls a batch, and blocks are read when their first is due.
    """

    BLOCK = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "number long", "boundaries string")
        self.now = handle.getValueState("now", "open string, near string, starts string, timer long")

    def _read(self) -> tuple:
        now = self.now.get()
        return (None, [], [], None) if now is None else (json.loads(now[0]), [tuple(x) for x in json.loads(now[1])], json.loads(now[2]), now[3])

    def _write(self, last, near: list, starts: list, timer: int | None) -> None:
        """Keep the state; ``starts`` has each block's first time and number."""
        if len(near) > self.BLOCK:
            near, number = sorted(near), 1 + max((n for _, n in starts), default=0)
            for at in range(0, len(near), self.BLOCK):
                self.blocks.updateValue((number,), (json.dumps(near[at : at + self.BLOCK]),))
                starts.append((near[at][0], number))
                number += 1
            near = []
        held = [b[0] for b in near] + [ts for ts, _ in starts]
        due = min(held) // 1000 + 1 if held else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.now.update((json.dumps(last), json.dumps(near), json.dumps(starts), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, near, starts, timer = self._read()
        for b in rows:
            near += zip(*(b[c].tolist() for c in ("ts", "event_id", "request_state", "category", "burst_id")), strict=True)
        self._write(last, near, starts, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, held, starts, _ = self._read()
        end = timerValues.getCurrentWatermarkInMs() * 1000
        for _, number in (s for s in starts if s[0] < end):
            held += [tuple(x) for x in json.loads(self.blocks.getValue((number,))[0])]
            self.blocks.removeKey((number,))
        out, near = [], []
        for b in sorted(held):
            if b[0] >= end:
                near.append(b)
                continue
            ts, event, state, category, burst = b
            if last is not None:
                out.append((key[0], *last, ts))
            last = (category, burst, state, ts, event)
        self._write(last, near, [s for s in starts if s[0] >= end], None)
        if out:
            yield pd.DataFrame(out, columns=LINK_COLUMNS)

    def close(self) -> None:
        pass


LINK_COLUMNS = [c.split()[0] for c in LINKED.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_links(requests: DataFrame, late: str = EMISSION_DELAY) -> DataFrame:
    """A stream of boundaries, each with the time of the session's next one, emitted in order.

    A boundary takes its place once the watermark, ``late`` behind, has passed
    it, so that boundaries which arrive out of order still find theirs; it is
    emitted when the next one takes its own. With a column ``ready``, those
    that aren't have no place yet: they come again when they are. The state is
    kept in RocksDB, which a session's ``spark.sql.streaming.stateStore.providerClass``
    has to name when the stream starts (``with_rocksdb``).
    """
    rows = requests.where("ready") if "ready" in requests.columns else requests
    timed = rows.withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", late)
    return timed.groupBy("session_id").transformWithStateInPandas(Links(), LINKED, "append", "eventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def flushed_links(requests: DataFrame, emitted: DataFrame, now_us: int) -> DataFrame:
    """What is still held when a stream ends: the boundaries not emitted yet, each with the next one's time, a session's last with ``now_us``.

    A batch step over the logged boundaries, to run at shutdown; with what was
    emitted before, every boundary is there once.
    """
    keys = ["session_id", "burst_id", "request_state", "ts", "event_id"]
    every = link_next(requests.select("session_id", "category", *keys[1:]), ["session_id"], "ts", ["event_id", "burst_id"], "end_ts", F.lit(now_us).cast("long"))
    return every.join(emitted.select(*keys), keys, "left_anti").select("session_id", "category", "burst_id", "request_state", "ts", "event_id", "end_ts")


def stream_frames(events: DataFrame, frames: DataFrame, ring: int, padding_us: int) -> DataFrame:
    """A stream of events, each with the last frame at least ``padding_us`` older, from the newest ``ring`` frames of its session.

    Both streams (``session_id``, ``ts``, and ``event_id`` or ``frame_id``) go
    into one state; the ring bounds it. Frames and events of a batch are taken
    in time order, so an event's ring holds the frames up to its own time,
    however many a batch brings.
    """
    both = events.select("session_id", "ts", "event_id", F.lit(None).cast("long").alias("frame_id")).unionByName(frames.select("session_id", "ts", F.lit(None).cast("long").alias("event_id"), "frame_id"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        shots = rows[rows["frame_id"].notna()]
        kept = sorted(kept + [(int(t), int(f)) for t, f in zip(shots["ts"], shots["frame_id"], strict=True)])
        times, out = [t for t, _ in kept], []
        for ts, event in rows.loc[rows["event_id"].notna(), ["ts", "event_id"]].itertuples(index=False, name=None):
            at = bisect_right(times, ts - padding_us)
            oldest = max(0, bisect_right(times, ts) - ring)
            out.append((*key, int(event), int(ts), kept[at - 1][1] if at > oldest else None))
        state.update((json.dumps(kept[-ring:]),))
        yield pd.DataFrame({c: pd.Series([o[i] for o in out], dtype="Int64") for i, c in enumerate(("session_id", "event_id", "ts", "frame_id"))})

    return both.groupBy("session_id").applyInPandasWithState(step, "session_id long, event_id long, ts long, frame_id long", "ring string", "append", GroupStateTimeout.NoTimeout)


def seen(spans: DataFrame, now: int, window_us: int, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """What a live view shows of stretches: those that meet the last ``window_us``, cut to it."""
    inside = spans.where((F.col(end) >= now - window_us) & (F.col(start) <= now))
    return inside.withColumn(start, F.greatest(start, F.lit(now - window_us))).withColumn(end, F.least(end, F.lit(now)))
