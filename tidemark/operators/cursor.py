"""Cursor paths on and between monitors, for drawing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import inside


def movements(events: DataFrame, by: list[str], order: list[str], monitor: str = "frame_monitor", keep: tuple[str, ...] = ()) -> DataFrame:
    """Moves from one cursor position to the next where they differ and both lie on the frame's monitor: ``by``, ``start``, ``end``, and the columns ``keep`` of the event moved to."""
    known = events.where(F.size("cursor_position") >= 2)
    before = F.lag("cursor_position").over(Window.partitionBy(*by).orderBy(*order))
    on = lambda p: inside(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.col(monitor))
    rows = known.withColumn("start", before).withColumn("end", F.col("cursor_position"))
    return rows.where((F.col("start") != F.col("end")) & on(F.col("start")) & on(F.col("end"))).select(*by, "start", "end", *keep)


def _on(position: list, monitor: dict) -> bool:
    x, y = position[0], position[1]
    return monitor["left"] <= x < monitor["left"] + monitor["width"] and monitor["top"] <= y < monitor["top"] + monitor["height"]


def leaving(events: list[dict], monitor: dict | None) -> list[dict]:
    """The events after the first that are off a monitor, up to one on a third monitor; unknown monitors count as none until one is known."""
    placed = [e for e in events if e["cursor_position"] is not None and len(e["cursor_position"]) >= 2] if monitor else []
    out, other = [], None
    for e in placed[1:]:
        if not _on(e["cursor_position"], monitor):
            if other and e["monitor"] != other:
                break
            other = other or e["monitor"]
            out.append(e)
    return out


def carried(frames: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Frames (``events``, ``monitor``) whose events begin with those that left the frame before.

    What a frame hands on depends on what it was given, so frames are folded in
    order, batch by batch; a task holds the events of one frame.
    """
    dealt = frames.repartition(*by).sortWithinPartitions(*by, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pending = None, []
        for b in batches:
            out = []
            for own, events, monitor in zip(b[by].itertuples(index=False, name=None), b["events"], b["monitor"], strict=True):
                if own != key:
                    key, pending = own, []
                events = pending + (list(events) if events is not None else [])
                out.append(events)
                pending = leaving(events, monitor)
            yield b.assign(events=out)

    return dealt.mapInPandas(fold, frames.schema)


def largest(frames: DataFrame, width: str = "width", height: str = "height", fallback: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """One row: the largest width and height of all frames, or the fallback without any."""
    return frames.agg(F.coalesce(F.max(width), F.lit(fallback[0])).alias("width"), F.coalesce(F.max(height), F.lit(fallback[1])).alias("height"))


def reconstructed(matched: DataFrame) -> DataFrame:
    """An aggregation from each matched row with events: type ``mixed``, reason ``reconstructed``, the first event's monitor."""
    rows = matched.where(F.size("raw_events") > 0)
    first = F.get("raw_events", F.lit(0))
    return rows.select(F.col("start_time").alias("timestamp"), F.col("end_time").alias("end_timestamp"), F.lit("reconstructed").alias("reason"), F.lit("mixed").alias("event_type"), F.col("img").alias("screenshot_path"), F.col("raw_events").alias("events"), first["monitor"].alias("monitor"), F.coalesce("scale_factor", F.lit(1.0)).alias("scale_factor"))
