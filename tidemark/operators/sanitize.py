"""Link boundary records into intervals and give every event to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import assign_intervals, link_next


def frame_ts(frame: Column, path: Column, ts: Column) -> Column:
    """A boundary's own time: its frame's, else the one in its path, else the event's."""
    return F.coalesce(frame, path, ts)


def once(requests: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """The first of the requests that agree on ``by``."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*tie))
    return requests.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def valid(records: DataFrame, frame: str = "screenshot_timestamp", path: str = "screenshot_path") -> DataFrame:
    """Records whose frame has a time and a path; an empty path counts."""
    return records.where(F.col(frame).isNotNull() & F.col(path).isNotNull())


def linked(records: DataFrame, events: DataFrame, session: str, frame: str, own_end: str, tie: list[str], event_ts: str, unit: float = 1) -> DataFrame:
    """``records`` with ``start`` and ``end``: up to the next record; the last up to its own end, else one ``unit`` past the session's last event."""
    last = events.groupBy(session).agg((F.max(event_ts) + unit).alias("_last"))
    rows = records.join(last, session, "left").withColumn("start", F.col(frame))
    return link_next(rows, [session], "start", tie, "end", F.coalesce(F.col(own_end), F.col("_last"))).drop("_last")


def sanitized(records: DataFrame, events: DataFrame, session: str, frame: str, own_end: str, tie: list[str], event_ts: str, record: str) -> DataFrame:
    """Every event in ``(start, end]`` of a record, with the record's ``record`` column; events before the first start or after the last end drop out."""
    spans = linked(records, events, session, frame, own_end, tie, event_ts)
    return assign_intervals(events, spans, [session], event_ts, "start", "end", [record], left_open=True)


def counts(records: DataFrame, events: DataFrame, session: str, frame: str, path: str, own_end: str, tie: list[str], event_ts: str, record: str) -> DataFrame:
    """For each session: ``n_records``, ``n_valid``, ``n_events``, ``n_assigned``, ``n_outside`` (before the first start, or at or after the last end)."""
    good = valid(records, frame, path)
    spans = linked(good, events, session, frame, own_end, tie, event_ts)
    given = assign_intervals(events, spans, [session], event_ts, "start", "end", [record], left_open=True).groupBy(session).agg(F.count("*").alias("n_assigned"))
    edges = spans.groupBy(session).agg(F.min("start").alias("_first"), F.max("end").alias("_end"))
    outside = events.join(edges, session).where((F.col(event_ts) < F.col("_first")) | (F.col(event_ts) >= F.col("_end"))).groupBy(session).agg(F.count("*").alias("n_outside"))
    out = records.groupBy(session).agg(F.count("*").alias("n_records"), F.count(F.when(F.col(frame).isNotNull() & F.col(path).isNotNull(), 1)).alias("n_valid"))
    out = out.join(events.groupBy(session).agg(F.count("*").alias("n_events")), session, "full").join(given, session, "left").join(outside, session, "left")
    return out.fillna(0, ["n_records", "n_valid", "n_events", "n_assigned", "n_outside"])


def totals_of(events: DataFrame, by: list[str], order: list[str], cursor: str) -> DataFrame:
    """For each aggregation its number of events, and its first event's ``cursor``."""
    return events.groupBy(*by).agg(F.count("*").alias("num_events"), F.min_by(cursor, F.struct(*order)).alias(cursor))
