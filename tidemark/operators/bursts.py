"""Bursts: stretches of input of one category, their boundaries and splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import gap_islands, gap_islands_in_parts

START, MID, END = "start", "mid", "end"
STALE, SWITCH, SPLIT = "stale", "monitor_switch", "max_length_exceeded"


def with_bursts(events: DataFrame, gap: Column | int, session: str = "session_id", category: str = "category", ts: str = "ts", tie: str = "event_id", part: int | None = None) -> DataFrame:
    """``events`` with ``burst_no`` (from 1 in a session's category) and ``burst_start``, its first time.

    A burst goes on while the next event of its category comes within ``gap``.
    With ``part``, so much time at most goes to one task, whatever a session's size.
    """
    keys = [session, category]
    rows = gap_islands(events, keys, ts, [tie], gap, "burst_no") if part is None else gap_islands_in_parts(events, keys, ts, [tie], gap, part, "burst_no")
    return rows.withColumn("burst_start", F.min(ts).over(Window.partitionBy(session, category, "burst_no")))


def summaries(bursts: DataFrame, session: str = "session_id", category: str = "category", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """One row for each burst: first and last time, number of events, and ``burst_id``, its place among the session's starts."""
    own = bursts.groupBy(session, category, "burst_no").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.min_by(tie, F.struct(ts, tie)).alias("first_event"), F.max_by(tie, F.struct(ts, tie)).alias("last_event"), F.count("*").alias("num_events"))
    return own.withColumn("burst_id", F.row_number().over(Window.partitionBy(session).orderBy("start_ts", "first_event")).cast("bigint"))


@dataclass
class OpenBurst:
    """What is still open of one burst: the events since its last split, as (time, monitor, id)."""

    total: int
    queue: list[tuple] = field(default_factory=list)

    def push(self, ts: int, monitor: int, event: int) -> tuple[str, int, int, int] | None:
        """Take the next event; the boundary it makes, if any: reason, time, monitor and event.

        A change of monitor comes first: it is a boundary at this event, and the
        length isn't looked at. Else, past the total length, the burst splits
        after the event nearest to the middle of what is open.
        """
        out = None
        if self.queue and monitor != self.queue[-1][1]:
            out = (SWITCH, ts, monitor, event)
        elif self.queue and ts - self.queue[0][0] > self.total:
            twice = self.queue[0][0] + self.queue[-1][0]
            at = min(range(len(self.queue)), key=lambda i: (abs(2 * self.queue[i][0] - twice), i))
            mid = self.queue[at]
            del self.queue[: at + 1]
            out = (SPLIT, *mid)
        self.queue.append((ts, monitor, event))
        return out


def folded(bursts: DataFrame, totals: dict[str, int], session: str = "session_id", category: str = "category", ts: str = "ts", tie: str = "event_id", monitor: str = "monitor_index") -> DataFrame:
    """All boundaries of bursts: ``session``, ``category``, ``burst_no``, ``first_ts``, ``first_event``, ``request_state``, ``reason``, ``ts``, ``monitor_index``, ``event_id``.

    Starts, ends and changes of monitor come from each event's neighbours, in
    one window. Only bursts longer than their total can split, and where they do
    depends on the split before: their rows alone are folded in order, dealt over
    the tasks by session, category and number and sorted there by Spark; a
    task holds what is open of one burst.
    """
    keys = [session, category, "burst_no"]
    rows = bursts.select(*keys, F.col(ts).alias("ts"), F.col(monitor).alias("monitor_index"), F.col(tie).alias("event_id"))
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"first_ts": F.first("ts").over(w), "first_event": F.first("event_id").over(w), "_last": F.last("ts").over(whole), "_before": F.lag(F.struct("monitor_index")).over(w), "_more": F.lead(F.lit(True)).over(w)})
    said = lambda state, reason: F.struct(F.lit(state).alias("request_state"), F.lit(reason).alias("reason"))
    switched = F.col("_before").isNotNull() & ~F.col("_before.monitor_index").eqNullSafe(F.col("monitor_index"))
    marks = F.array_compact(F.array(F.when(F.col("_before").isNull(), said(START, STALE)), F.when(switched, said(MID, SWITCH)), F.when(F.col("_more").isNull(), said(END, STALE))))
    columns = [*keys, "first_ts", "first_event", "request_state", "reason", "ts", "monitor_index", "event_id"]
    plain = rows.withColumn("_mark", F.explode(marks)).select("*", "_mark.*").select(*columns)

    most = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col(category))
    long = rows.where(F.col("_last") - F.col("first_ts") > most).select(*keys, "first_ts", "first_event", "ts", "monitor_index", "event_id")
    dealt = long.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, burst = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if row[:3] != key:
                    key, burst = row[:3], OpenBurst(totals[row[1]])
                found = burst.push(*row[5:])
                if found and found[0] == SPLIT:
                    out.append((*row[:5], MID, *found))
            yield pd.DataFrame(out, columns=columns)

    splits = dealt.mapInPandas(fold, f"{session} {dict(rows.dtypes)[session]}, {category} string, burst_no bigint, first_ts bigint, first_event bigint, request_state string, reason string, ts bigint, monitor_index int, event_id bigint")
    return plain.unionByName(splits)


def middles(bursts: DataFrame, totals: dict[str, int], **columns: str) -> DataFrame:
    """The boundaries inside bursts, without ``first_ts``, ``first_event`` and ``request_state``."""
    return folded(bursts, totals, **columns).where(F.col("request_state") == MID).drop("first_ts", "first_event", "request_state")


def boundaries(events: DataFrame, gap: Column | int, totals: dict[str, int], part: int | None = None) -> DataFrame:
    """Starts, splits and ends of all bursts: ``session_id``, ``category``, ``burst_id``, ``request_state``, ``reason``, ``ts``, ``event_id``, ``monitor_index``.

    The few boundaries are ranked by their burst's start for its id.
    """
    rows = folded(with_bursts(events, gap, part=part), totals)
    place = F.dense_rank().over(Window.partitionBy("session_id").orderBy("first_ts", "first_event"))
    return rows.select("session_id", "category", place.cast("bigint").alias("burst_id"), "request_state", "reason", "ts", "event_id", "monitor_index")


def throttled(events: DataFrame, every_us: int, always: Column, by: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Drop events that come less than ``every_us`` after the last one kept of their ``by``, unless ``always``.

    What is kept depends on what was kept before, so rows are folded in order,
    batch by batch; a task holds one time only.
    """
    rows = events.withColumn("_always", always)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, ts, tie)
    at = [rows.columns.index(c) for c in by]
    when, free = rows.columns.index(ts), rows.columns.index("_always")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            keep = []
            for row in b.itertuples(index=False, name=None):
                own = tuple(row[i] for i in at)
                good = own != key or row[free] or row[when] - last >= every_us
                if good:
                    key, last = own, row[when]
                keep.append(bool(good))
            yield b[keep]

    return dealt.mapInPandas(fold, rows.schema).drop("_always")
