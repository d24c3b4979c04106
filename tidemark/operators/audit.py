"""Checks of what was recorded against what was aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import category
from tidemark.schemas import CATEGORIES


def reconcile(events: DataFrame, captured: DataFrame, by: list[str]) -> DataFrame:
    """``events`` with ``n_captured`` and ``status``: ``unmatched``, ``unique`` or ``duplicate``, by how often ``captured`` has their key."""
    counted = captured.groupBy(*by).agg(F.count("*").alias("n_captured"))
    joined = events.join(counted, by, "left").withColumn("n_captured", F.coalesce("n_captured", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("n_captured") == 0, "unmatched").when(F.col("n_captured") == 1, "unique").otherwise("duplicate"))


def orphans(events: DataFrame, captured: DataFrame, by: list[str]) -> DataFrame:
    """Events that were never captured."""
    return events.join(captured.select(*by), by, "left_anti")


def category_intervals(requests: DataFrame, session: str = "session_id", kind: str = "category", ts: str = "ts", state: str = "request_state", tie: str = "event_id") -> DataFrame:
    """Start-to-end intervals (``start_ts``, ``end_ts``) of each session's category, in time order.

    A later start replaces an open one, an end without a start is ignored, and
    boundaries in the middle don't count. At equal times starts come first.
    """
    w = Window.partitionBy(session, kind).orderBy(ts, F.when(F.col(state) == "start", 0).otherwise(1), tie)
    rows = requests.where(F.col(kind).isin(*CATEGORIES) & F.col(state).isin("start", "end") & F.col(ts).isNotNull())
    before = F.lag(F.struct(F.col(state).alias("state"), F.col(ts).alias("ts"))).over(w)
    rows = rows.withColumn("_before", before)
    return rows.where((F.col(state) == "end") & (F.col("_before.state") == "start")).select(session, kind, F.col("_before.ts").alias("start_ts"), F.col(ts).alias("end_ts"))


def timestamps(records: DataFrame, session: str = "session_id") -> DataFrame:
    """All times of mixed records, repeats included: their own, their ``events``' and their ``event``'s. What isn't a number is left out."""
    own = F.array(F.col("timestamp").cast("string"))
    inner = F.transform(F.coalesce("events", F.array()), lambda e: e["timestamp"].cast("string"))
    one = F.array(F.col("event")["timestamp"].cast("string")) if "event" in records.columns else F.array().cast("array<string>")
    rows = records.select(session, F.explode(F.concat(own, inner, one)).alias("t"))
    return rows.select(session, F.col("t").try_cast("double").alias("timestamp")).where("timestamp is not null")


def inner_events(records: DataFrame, session: str = "session_id") -> DataFrame:
    """Times of the events inside records by category: ``category``, ``timestamp``, with their key in microseconds."""
    rows = records.select(session, F.explode("events").alias("e")).select(session, category(F.col("e.event_type")).alias("category"), F.col("e.timestamp").alias("timestamp"))
    return rows.where("category is not null and timestamp is not null").withColumn("key", F.bround(F.col("timestamp") * 1_000_000).cast("bigint"))


def shown(orphans: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` orphans in order: what a report shows of them."""
    return orphans.orderBy(*order).limit(most)
