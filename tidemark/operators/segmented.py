"""Scans along time whose groups are too large for one task.

A group is cut into parts of time. Each part is scanned by itself; of each one
row, its summary, goes into a second scan over the parts of the group, and what
that carries into a part comes back by a join. So a session with a third of all
rows is spread over its parts, and only a row for each part comes together.

Times and group keys are not null here; ``part`` is a length of time in the
unit of ``ts``, chosen so that a part of the busiest group fits one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.temporal import asof, gap_islands_in_parts
from tidemark.sources.sinks import kept

PART = "_part"


def cut(rows: DataFrame, ts: str, part: int) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).withColumn(PART, F.floor(F.col(ts) / part).cast("bigint"))


def within(by: list[str], order: list[str]) -> WindowSpec:
    """All rows of a part up to the one at hand, in order."""
    return Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, by: list[str], summaries: dict[str, Column], carries: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` with what the other parts carry into theirs: aggregates ``summaries`` of each part, then ``carries`` over windows of the group's parts, forward and back."""
    ends = rows.groupBy(*by, PART).agg(*(c.alias(n) for n, c in summaries.items()))
    parts = Window.partitionBy(*by)
    found = carries(parts.orderBy(PART), parts.orderBy(F.col(PART).desc()))
    return rows.join(ends.select(*by, PART, *(c.alias(n) for n, c in found.items())), [*by, PART])


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def numbered_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], part: int, name: str = "position") -> DataFrame:
    """Number rows from 1 in order of time, then ``tie``."""
    local = cut(rows, ts, part).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, PART).orderBy(ts, *tie)))
    out = carried(local, by, {"_n": F.count("*")}, lambda w, back: {"_base": _zero(F.sum("_n").over(_before(w)))})
    return out.withColumn(name, (F.col("_base") + F.col("_nth")).cast("bigint")).drop(PART, "_nth", "_base")


def chunks_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], size: int, part: int, name: str = "chunk_index") -> DataFrame:
    """As ``chunks``: number (from 0) the chunks of ``size`` rows in order."""
    return numbered_in_parts(rows, by, ts, tie, part, "_position").withColumn(name, F.floor((F.col("_position") - 1) / size).cast("int")).drop("_position")


def link_next_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], part: int, name: str = "end_ts", last: Column | None = None) -> DataFrame:
    """As ``link_next``: the next row's time in order; the last row has ``last``, or null."""
    local = cut(rows, ts, part).withColumn("_next", F.lead(ts).over(Window.partitionBy(*by, PART).orderBy(ts, *tie)))
    out = carried(local, by, {"_first": F.min(ts)}, lambda w, back: {"_later": F.lead("_first").over(w)})
    nxt = F.coalesce("_next", "_later")
    return out.withColumn(name, nxt if last is None else F.coalesce(nxt, last)).drop(PART, "_next", "_later")


def runs_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], value: str, part: int, name: str = "run") -> DataFrame:
    """As ``runs``: number (from 1) the runs of rows with an equal ``value``; nulls equal nulls."""
    w = Window.partitionBy(*by, PART).orderBy(ts, *tie)
    before = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    local = cut(rows, ts, part).withColumn("_change", F.coalesce((before.isNotNull() & ~before["v"].eqNullSafe(F.col(value))).cast("int"), F.lit(0)))
    local = local.withColumn("_local", F.sum("_change").over(within(by, [ts, *tie])))
    place, own = F.struct(ts, *tie), F.struct(F.col(value).alias("v"))
    ends = {"_inside": F.sum("_change"), "_first": F.min_by(own, place), "_last": F.max_by(own, place)}

    # whether a part begins a run is itself known by a window, so the sums take a second one
    ends_of = local.groupBy(*by, PART).agg(*(c.alias(n) for n, c in ends.items()))
    parts = Window.partitionBy(*by).orderBy(PART)
    last = F.lag("_last").over(parts)
    ends_of = ends_of.withColumn("_begins", F.when(last.isNotNull() & last["v"].eqNullSafe(F.col("_first.v")), 0).otherwise(1))
    base = F.sum(F.col("_begins") + F.col("_inside")).over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")
    out = local.join(ends_of.select(*by, PART, base.alias("_base")), [*by, PART])
    return out.withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint")).drop(PART, "_change", "_local", "_base")


def reordered_in_parts(rows: DataFrame, by: list[str], ts: str, tie: list[str], part: int, kind: str = "event_type", name: str = "position") -> DataFrame:
    """As ``reordered``: in each block of moves and scrolls the scrolls come first.

    A row's new place follows from sums: its place in time, the scrolls up to
    it, and both of these where its block begins and ends, which the parts carry
    forward and back.
    """
    place = [ts, *tie]
    w = Window.partitionBy(*by, PART).orderBy(*place)
    loose, scroll = F.col(kind).isin("mouse_move", "mouse_scroll"), (F.col(kind) == "mouse_scroll").cast("int")
    local = cut(rows, ts, part).withColumn("_loose", F.coalesce(loose, F.lit(False))).withColumn("_scroll", F.coalesce(scroll, F.lit(0)))
    local = local.withColumn("_before", F.lag("_loose").over(w)).withColumn("_nth", F.row_number().over(w)).withColumn("_scrolls", F.sum("_scroll").over(within(by, place)))
    local = carried(
        local, by, {"_n": F.count("*"), "_all": F.sum("_scroll"), "_final": F.max_by("_loose", F.struct(*place))},
        lambda w, back: {"_rows": _zero(F.sum("_n").over(_before(w))), "_sums": _zero(F.sum("_all").over(_before(w))), "_last": F.lag("_final").over(w)},
    )
    local = local.withColumn("_nth", F.col("_rows") + F.col("_nth")).withColumn("_scrolls", F.col("_sums") + F.col("_scrolls")).withColumn("_before", F.coalesce("_before", "_last", F.lit(False)))
    # where a block begins: the rows and scrolls before it
    begins = F.when(~F.col("_loose") | ~F.col("_before"), F.struct((F.col("_nth") - 1).alias("r"), (F.col("_scrolls") - F.col("_scroll")).alias("s")))
    local = local.withColumn("_begin", begins).drop("_rows", "_sums", "_last", "_before")
    local = local.withColumn("_from", F.last("_begin", ignorenulls=True).over(within(by, place))).withColumn("_to", F.last("_begin", ignorenulls=True).over(_before(Window.partitionBy(*by, PART).orderBy(*(F.col(c).desc() for c in place)))))
    out = carried(
        local, by, {"_first": F.min("_begin"), "_end": F.max("_begin"), "_total": F.max("_scrolls")},
        lambda w, back: {"_earlier": F.last("_end", ignorenulls=True).over(_before(w)), "_later": F.last("_first", ignorenulls=True).over(_before(back)), "_whole": F.max("_total").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))},
    )
    start, stop = F.coalesce("_from", "_earlier"), F.coalesce(F.coalesce("_to", "_later")["s"], F.col("_whole"))
    so_far = F.col("_scrolls") - start["s"]
    moved = F.when(F.col("_scroll") == 1, start["r"] + so_far).otherwise(F.col("_nth") + (stop - start["s"]) - so_far)
    out = out.withColumn(name, F.when(F.col("_loose"), moved).otherwise(F.col("_nth")).cast("bigint"))
    return out.select(*rows.columns, name)


def asof_next_in_parts(probes: DataFrame, frames: DataFrame, by: list[str], probe_ts: str, frame_ts: str, take: list[str], part: int, tie: str | None = None) -> DataFrame:
    """As ``asof`` forward: the first frame at or after each probe, of its own part of time or the first of the parts after it."""
    own = cut(frames, frame_ts, part).withColumn("_hit", F.lit(True))
    near = asof(cut(probes, probe_ts, part), own, [*by, PART], probe_ts, frame_ts, [*take, "_hit"], backward=False, tie=tie)
    first = F.min_by(F.struct(*take), F.struct(frame_ts, tie) if tie else F.col(frame_ts))
    ends = own.groupBy(*by, PART).agg(first.alias("_seen"))
    every = ends.unionByName(near.select(*by, PART).distinct(), allowMissingColumns=True).groupBy(*by, PART).agg(F.first("_seen", ignorenulls=True).alias("_seen"))
    later = every.select(*by, PART, F.last("_seen", ignorenulls=True).over(_before(Window.partitionBy(*by).orderBy(F.col(PART).desc()))).alias("_carried"))
    joined = near.join(later, [*by, PART], "left")
    return joined.select(*probes.columns, *(F.when(F.col("_hit"), F.col(c)).otherwise(F.col("_carried")[c]).alias(c) for c in take))


def throttled_in_parts(events: DataFrame, every_us: int, always: Column, by: list[str], part: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """As ``throttled``, without a fold: drop events less than ``every_us`` after the last one kept of their ``by``, unless ``always``.

    ``tie`` tells the events of a ``by`` apart. Events that come ``every_us`` or
    more after the one before, and those that are always kept, are kept whatever
    went before. From each event the next one kept, were it kept itself, is known
    by an as-of join: the first at least ``every_us`` later. Along these links the
    kept ones are those that can be reached from the sure ones. A round doubles
    the links' reach, so a stretch with n kept events takes log2(n) rounds.
    """
    rows = events.withColumn("_sure", F.coalesce(always, F.lit(False)))
    islands = gap_islands_in_parts(rows, by, ts, [tie], every_us - 1, part, "_island")
    # an event that is always kept begins a stretch of its own
    place = Window.partitionBy(*by, PART).orderBy(ts, tie)
    local = cut(islands, ts, part).withColumn("_was", F.lag("_island").over(place)).withColumn("_sures", F.sum(F.col("_sure").cast("int")).over(within(by, [ts, tie])))
    local = carried(local, by, {"_n": F.max("_sures"), "_final": F.max("_island")}, lambda w, back: {"_base": _zero(F.sum("_n").over(_before(w))), "_last": F.lag("_final").over(w)})
    stretch = F.struct("_island", (F.col("_base") + F.col("_sures")).alias("_sures"))
    sure = F.col("_sure") | ~F.coalesce(F.coalesce("_was", "_last") == F.col("_island"), F.lit(False))
    marked = kept(local.select(*by, ts, tie, stretch.alias("_stretch"), sure.alias("_sure")), "stretches")
    probes = marked.select(*by, F.col(tie).alias("_a"), (F.col(ts) + every_us).alias("_when"), F.col("_stretch").alias("_own"))
    found = asof_next_in_parts(probes, marked.select(*by, ts, F.col(tie).alias("_b"), F.col("_stretch").alias("_theirs")), by, "_when", ts, ["_b", "_theirs"], part, tie="_b")
    links = kept(found.where(F.col("_own") == F.col("_theirs")).select(*by, "_a", "_b"), "links")
    reached = kept(marked.where("_sure").select(*by, F.col(tie).alias("_a")), "reached")
    while links.limit(1).count():
        more = reached.join(links, [*by, "_a"]).select(*by, F.col("_b").alias("_a"))
        reached = kept(reached.unionByName(more).distinct(), "reached")
        links = kept(links.join(links.select(*by, F.col("_a").alias("_b"), F.col("_b").alias("_c")), [*by, "_b"]).select(*by, "_a", F.col("_c").alias("_b")), "links")
    return rows.join(reached.withColumnRenamed("_a", tie), [*by, tie], "left_semi").select(*events.columns)


def _folded(by: list[str], order: list[str], threshold: int, out: str):
    """Pandas function over parts, sorted one after the other: the keys of rows that stay, or (``out`` is ``ends``) a row for each part with the hash it ends with; ``_known`` and ``_in`` are the hash carried in."""
    part = [*by, PART]
    columns = [*part, "_end_known", "_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            keep, ends = [], []
            for own, absent, bits, known, came in zip(zip(*(b[c] for c in part), strict=True), b["_absent"], b["_hash"], b["_known"], b["_in"], strict=True):
                if own != key:
                    if key is not None:
                        ends.append((*key, last is not None, 0 if last is None else last))
                    key, last = own, came if known else None
                good = absent or last is None or ((last ^ bits) & ((1 << 64) - 1)).bit_count() > threshold
                if good:
                    last = None if absent else bits
                keep.append(bool(good))
            yield b.loc[keep, [*by, *order]] if out == "rows" else pd.DataFrame(ends, columns=columns)
        if out == "ends" and key is not None:
            yield pd.DataFrame([(*key, last is not None, 0 if last is None else last)], columns=columns)

    return run


def keep_changed_in_parts(frames: DataFrame, by: list[str], ts: str, tie: list[str], hash_col: str, part: int, threshold: int = 1) -> DataFrame:
    """As ``keep_changed``: frames that differ in more than ``threshold`` bits from the last one kept; a part of time at a time.

    What a part keeps depends on the hash that is carried into it. All parts
    are folded as if nothing were; then those into which the part before carries
    something else are folded again, until nothing changes. Mostly a part ends
    with the same hash whatever comes in, since two folds agree from the first
    frame on that both keep: few parts are folded twice. At worst each round
    mends one part of each group. Parts are dealt over the tasks and sorted there by
    Spark, and folded one after the other, batch by batch: a part costs no call of its own.
    """
    place = [ts, *tie]
    slim = cut(frames, ts, part).select(*by, PART, *place, F.col(hash_col).isNull().alias("_absent"), F.coalesce(F.col(hash_col), F.lit(0)).cast("bigint").alias("_hash"))
    slim = kept(slim, "hashes")
    kinds = dict(slim.dtypes)
    ends_schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, PART]) + ", _end_known boolean, _end bigint"
    dealt = lambda df: df.repartition(*by, PART).sortWithinPartitions(*by, PART, *place)
    ends = lambda df: dealt(df).mapInPandas(_folded(by, place, threshold, "ends"), ends_schema)
    nothing = (F.lit(False).alias("_known"), F.lit(0).cast("bigint").alias("_in"))
    state = kept(ends(slim.select("*", *nothing)).select("*", *nothing), "ends")
    order = Window.partitionBy(*by).orderBy(PART)
    while True:
        now = state.withColumn("_new_known", F.coalesce(F.lag("_end_known").over(order), F.lit(False))).withColumn("_new", F.when(F.col("_new_known"), F.lag("_end").over(order)).otherwise(0).cast("bigint"))
        now = kept(now.withColumn("_changed", (F.col("_new_known") != F.col("_known")) | (F.col("_new") != F.col("_in"))), "ends")
        if not now.where("_changed").limit(1).count():
            break
        again = now.where("_changed").select(*by, PART, F.col("_new_known").alias("_known"), F.col("_new").alias("_in"))
        mended = ends(slim.join(again, [*by, PART])).join(again, [*by, PART])
        state = kept(now.where("not _changed").select(*state.columns).unionByName(mended.select(*state.columns)), "ends")
    carry = state.select(*by, PART, "_known", "_in")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, *place])
    stay = dealt(slim.join(carry, [*by, PART])).mapInPandas(_folded(by, place, threshold, "rows"), schema)
    return frames.join(stay.select(*by, *place), [*by, *place], "left_semi")
