"""Joins and groupings along time: as-of, intervals, links, gaps and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, frames: DataFrame, by: list[str], probe_ts: str, frame_ts: str, take: list[str], backward: bool = True, strict: bool = False, tie: str | None = None) -> DataFrame:
    """``probes`` with the columns ``take`` of the frame last seen (or next to come).

    Both tables are put in one order and a window carries the frame along: one
    shuffle on ``by``, no pairs. At equal times a frame counts, unless
    ``strict``. Of frames at the same time the one last by ``tie`` (a column of
    ``frames``) counts backward, the first one forward. Probes without such a
    frame have nulls; null times match nothing.
    """
    names = probes.columns
    side, when, own, seen, order = "_side", "_when", "_own", "_seen", "_order"
    left = probes.select(*by, F.col(probe_ts).alias(when), F.lit(0 if strict else 1).alias(side), F.lit(None).cast(frames.schema[tie].dataType if tie else "string").alias(order), F.struct(*names).alias(own))
    tie_col = F.lit(None).cast("string") if tie is None else F.col(tie)
    right = frames.where(F.col(frame_ts).isNotNull()).select(*by, F.col(frame_ts).alias(when), F.lit(1 if strict else 0).alias(side), tie_col.alias(order), F.struct(*take).alias(seen))
    both = left.unionByName(right, allowMissingColumns=True)
    keys = [F.col(when).asc_nulls_first() if backward else F.col(when).desc_nulls_first(), F.col(side), F.col(order) if backward else F.col(order).desc()]
    w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn(seen, F.last(seen, ignorenulls=True).over(w)).where(F.col(own).isNotNull())
    return joined.select(*(F.col(f"{own}.`{c}`").alias(c) for c in names), *(F.col(f"{seen}.`{c}`").alias(c) for c in take))


def asof_preferring(probes: DataFrame, frames: DataFrame, by: list[str], prefer: str, probe_ts: str, frame_ts: str, take: list[str], tie: str | None = None) -> DataFrame:
    """The next frame at or after each probe: the next with an equal ``prefer``, else the next of all."""
    near = {c: f"_near_{c}" for c in take}
    same = asof(probes, frames.select(*by, prefer, frame_ts, *(F.col(c).alias(near[c]) for c in take), *([F.col(tie).alias("_tie")] if tie else [])), [*by, prefer], probe_ts, frame_ts, list(near.values()), backward=False, tie="_tie" if tie else None)
    every = asof(same, frames, by, probe_ts, frame_ts, take, backward=False, tie=tie)
    found = F.col(near[take[0]]).isNotNull()
    return every.select(*probes.columns, *(F.when(found, F.col(near[c])).otherwise(F.col(c)).alias(c) for c in take))


def newest_within(probes: DataFrame, frames: DataFrame, by: list[str], low_ts: str, high_ts: str, frame_ts: str, take: list[str], tie: str | None = None) -> DataFrame:
    """The newest frame no later than ``high_ts``, if it is no earlier than ``low_ts``."""
    found = asof(probes, frames.withColumn("_at", F.col(frame_ts)), by, high_ts, frame_ts, [*take, "_at"], tie=tie)
    good = F.col("_at") >= F.col(low_ts)
    return found.select(*probes.columns, *(F.when(good, F.col(c)).alias(c) for c in take))


def assign_intervals(events: DataFrame, intervals: DataFrame, by: list[str], ts: str, start: str, end: str, take: list[str], left_open: bool = False) -> DataFrame:
    """Events with the columns ``take`` of their interval: ``[start, end)``, or ``(start, end]`` if ``left_open``.

    Intervals of one ``by`` don't overlap, so the last one begun is the only
    candidate. A null end is open. Events in no interval are left out.
    """
    ends = intervals.withColumn("_end", F.col(end)).withColumn("_begun", F.lit(True))
    found = asof(events, ends, by, ts, start, [*take, "_end", "_begun"], strict=left_open)
    within = F.col(ts) <= F.col("_end") if left_open else F.col(ts) < F.col("_end")
    return found.where(F.col("_begun") & F.coalesce(within, F.col("_end").isNull())).select(*events.columns, *take)


def link_next(rows: DataFrame, by: list[str], ts: str, tie: list[str], name: str = "end_ts", last: Column | None = None) -> DataFrame:
    """``rows`` with the next row's ``ts`` in order; the last one has ``last``, or null."""
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    nxt = F.lead(ts).over(w)
    return rows.withColumn(name, nxt if last is None else F.coalesce(nxt, last))


def gap_islands(rows: DataFrame, by: list[str], ts: str, tie: list[str], gap: Column | int, name: str = "island") -> DataFrame:
    """Number the stretches of rows (from 1) which are no more than ``gap`` apart.

    A null time joins the stretch at hand and is skipped by the next comparison;
    null times come first in order.
    """
    order = Window.partitionBy(*by).orderBy(F.col(ts).asc_nulls_first(), *tie)
    before = F.last(ts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = (F.row_number().over(order) == 1) | F.coalesce(F.col(ts) - before > gap, F.lit(False))
    marked = rows.withColumn("_breaks", breaks.cast("int"))
    return marked.withColumn(name, F.sum("_breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_breaks")


def gap_islands_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], gap: Column | int, part: int, name: str = "island") -> DataFrame:
    """As ``gap_islands`` for known times, but no task orders more than ``part`` of a ``by``'s time.

    Gaps inside a part of time are found there. One row for each part, with its
    ends and the gaps in it, tells whether a gap lies before it and how many
    went before; that comes back by a join. For ``by`` values too large for one
    task: even a third of all rows is spread over its parts.
    """
    order = Window.partitionBy(*by, "_part").orderBy(ts, *tie)
    cut = rows.where(F.col(ts).isNotNull()).withColumn("_part", F.floor(F.col(ts) / part).cast("bigint")).withColumn("_gap", gap if isinstance(gap, Column) else F.lit(gap))
    inside = F.coalesce(F.col(ts) - F.lag(ts).over(order) > F.col("_gap"), F.lit(False)).cast("int")
    marked = cut.withColumn("_breaks", inside).withColumn("_local", F.sum("_breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*by, "_part").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.min_by("_gap", ts).alias("_own"), F.sum("_breaks").alias("_inside"))
    parts = Window.partitionBy(*by).orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_last").over(parts))
    ends = ends.withColumn("_begins", (F.col("_before").isNull() | (F.col("_first") - F.col("_before") > F.col("_own"))).cast("int"))
    base = F.sum(F.col("_begins") + F.col("_inside")).over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")
    ends = ends.select(*by, "_part", base.alias("_base"))
    return marked.join(ends, [*by, "_part"]).withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint")).drop("_part", "_gap", "_breaks", "_local", "_base")


def asof_in_parts(probes: DataFrame, frames: DataFrame, by: list[str], probe_ts: str, frame_ts: str, take: list[str], part: int, tie: str | None = None) -> DataFrame:
    """As ``asof`` backward, but no task orders more than ``part`` of a ``by``'s time.

    A probe is looked up among the frames of its own part of time. Those that
    come before the first of these take the last frame of the parts before,
    found among one row for each part.
    """
    cut = lambda df, ts: df.withColumn("_part", F.floor(F.col(ts) / part).cast("bigint"))
    own = cut(frames.where(F.col(frame_ts).isNotNull()), frame_ts).withColumn("_hit", F.lit(True))
    near = asof(cut(probes, probe_ts), own, [*by, "_part"], probe_ts, frame_ts, [*take, "_hit"], tie=tie)
    last = F.max_by(F.struct(*take), F.struct(frame_ts, tie) if tie else F.col(frame_ts))
    ends = own.groupBy(*by, "_part").agg(last.alias("_seen"))
    # a row for each part in which there are probes or frames, carrying what the parts before it have seen
    every = ends.unionByName(near.select(*by, "_part").distinct(), allowMissingColumns=True).groupBy(*by, "_part").agg(F.first("_seen", ignorenulls=True).alias("_seen"))
    before = F.last("_seen", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select(*by, "_part", before.alias("_carried"))
    joined = near.join(carried, [*by, "_part"], "left")
    return joined.select(*probes.columns, *(F.when(F.col("_hit"), F.col(c)).otherwise(F.col("_carried")[c]).alias(c) for c in take))


def split_frames(rows: DataFrame, by: list[str], position: str, ts: str, gap: float, name: str = "segment") -> DataFrame:
    """Segments (from 1) of frames in ``position`` order, where two known times differ by more than ``gap``.

    A frame without a time stays in the segment at hand. If the first one has
    none, nothing is split.
    """
    order = Window.partitionBy(*by).orderBy(position)
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    before, first = F.last(ts, ignorenulls=True).over(so_far), F.first(ts).over(order.rowsBetween(Window.unboundedPreceding, 0))
    breaks = F.coalesce(first.isNotNull() & (F.abs(F.col(ts) - before) > gap), F.lit(False)).cast("int")
    return rows.withColumn("_breaks", breaks).withColumn(name, (F.sum("_breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("bigint")).drop("_breaks")


def runs(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Number (from 1) the runs of rows in ``order`` with an equal ``value``; nulls equal nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_change")


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int, name: str = "chunk_index") -> DataFrame:
    """Number (from 0) the chunks of ``size`` rows in order."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn(name, F.floor(nth / size).cast("int"))


def newest(rows: DataFrame, by: list[str], ts: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each ``by``: what a bounded buffer holds."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def chunk_frames(rows: DataFrame, by: list[str], order: list[str], size: int, path: str, ts: str) -> DataFrame:
    """Chunks of ``size`` rows in order: ``by``, ``chunk_index``, ``n_rows``, first and last time, and the rows' ``paths``, in order."""
    numbered = chunks(rows, by, order, size)
    paths = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(path).alias("_path")))), lambda x: x["_path"])
    return numbered.groupBy(*by, "chunk_index").agg(F.count("*").alias("n_rows"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), paths.alias("paths"))


def active_bursts(boundaries: DataFrame, by: list[str], now: int, ts: str = "ts", state: str = "request_state") -> DataFrame:
    """How many bursts of each ``by`` are open at a time: starts up to ``now`` less ends up to it."""
    step = F.when(F.col(state) == "start", 1).when(F.col(state) == "end", -1).otherwise(0)
    return boundaries.where(F.col(ts) <= now).groupBy(*by).agg(F.sum(step).alias("n_active"))


def burst_for(probes: DataFrame, ids: DataFrame, session: str, category: str, ts: str, latest_ts: str) -> DataFrame:
    """``probes`` with ``burst_id``: of the burst of their category last begun at ``ts``; without one, of the session's latest at ``latest_ts``."""
    own = asof(probes, ids.select(session, category, "start_ts", F.col("burst_id").alias("_own")), [session, category], ts, "start_ts", ["_own"], tie="_own")
    every = asof(own, ids.select(session, "start_ts", F.col("burst_id").alias("_any")), [session], latest_ts, "start_ts", ["_any"], tie="_any")
    return every.withColumn("burst_id", F.coalesce("_own", "_any")).drop("_own", "_any")


def segment_chunks(rows: DataFrame, by: list[str], position: str, segment: str, size: int, fps: int = 1) -> DataFrame:
    """Chunks of ``size`` frames within segments, numbered (from 0) through the ``by``: ``chunk_index``, ``n_frames``, and ``start_seconds``, the frames before it at ``fps`` a second."""
    sizes = chunks(rows, [*by, segment], [position], size, "_part").groupBy(*by, segment, "_part").agg(F.count("*").alias("n_frames"))
    w = Window.partitionBy(*by).orderBy(segment, "_part")
    before = F.coalesce(F.sum("n_frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*by, (F.row_number().over(w) - 1).alias("chunk_index"), "n_frames", (before if fps == 1 else before / fps).alias("start_seconds"))
