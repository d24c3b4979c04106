"""Exports: captions with their pictures, and train, test and validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timefmt import clock_seconds, stamp, unstamp


def from_matched(rows: DataFrame) -> DataFrame:
    """Export records of matched captions: ``text``, ``start_time``, ``end_time``, ``img``."""
    return rows.select(F.col("caption").alias("text"), stamp(F.col("start_time")).alias("start_time"), stamp(F.col("end_time")).alias("end_time"), "img")


def from_captions(captions: DataFrame, shots: DataFrame, session: str, keep: list[str]) -> DataFrame:
    """Export records of captions (``start``, ``end`` as ``MM:SS``, ``caption``) by their place among a session's ``shots`` (``path``, ``ts``).

    A caption starts at the picture of its first second and ends at the one a
    second past its last, or the last of all. Captions without a first picture
    are left out.
    """
    w = Window.partitionBy(session).orderBy("ts", "path")
    numbered = shots.withColumn("i", F.row_number().over(w) - 1)
    last = shots.groupBy(session).agg(F.max("ts").alias("_last"))
    first = numbered.select(session, F.col("i").alias("_s"), F.col("ts").alias("_from"), F.col("path").alias("img"))
    end = numbered.select(session, F.col("i").alias("_e"), F.col("ts").alias("_to"))
    rows = captions.withColumn("_s", clock_seconds(F.col("start"))).withColumn("_e", clock_seconds(F.col("end")) + 1)
    rows = rows.join(first, [session, "_s"]).join(end, [session, "_e"], "left").join(last, session)
    return rows.select(session, *keep, F.col("caption").alias("text"), stamp(F.col("_from")).alias("start_time"), stamp(F.coalesce("_to", "_last")).alias("end_time"), "img")


def format_of(columns: list[str]) -> int:
    """Which of two export sources a record layout is: 1 for matched captions, 2 for captions alone."""
    if {"img", "raw_events"} <= set(columns):
        return 1
    if {"start", "chunk_index"} <= set(columns):
        return 2
    raise ValueError("neither matched captions nor captions")


def _named(position: Column, train: Column, test: Column) -> Column:
    return F.when(position <= train, "train").when(position <= test, "test").otherwise("validation")


def split_by_ratio(rows: DataFrame, by: list[str], order: list[str], ratios: list[float]) -> DataFrame:
    """``rows`` with ``split``: in order, the first and second shares, cut off to whole rows; the rest is validation."""
    if len(ratios) != 3 or not 0.99 <= sum(ratios) <= 1.01:
        raise ValueError("three ratios that sum to 1")
    n = F.count("*").over(Window.partitionBy(*by))
    train, test = ((n * F.lit(r)).cast("int") for r in ratios[:2])
    return rows.withColumn("split", _named(F.row_number().over(Window.partitionBy(*by).orderBy(*order)), train, train + test))


def split_by_time(rows: DataFrame, by: list[str], order: list[str], seconds: Column, durations: list[int]) -> DataFrame:
    """``rows`` with ``split``: train up to the last row before the first cutoff, test up to the last before the second, then validation.

    Cutoffs count from the first row in order; the third duration isn't used.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_t", seconds).withColumn("_i", F.row_number().over(w))
    first = F.first("_t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_first", first)
    every = Window.partitionBy(*by)
    last = lambda until: F.coalesce(F.max(F.when(F.col("_t") < F.col("_first") + until, F.col("_i"))).over(every), F.lit(0))
    return rows.withColumn("split", _named(F.col("_i"), last(durations[0]), last(durations[0] + durations[1]))).drop("_t", "_i", "_first")


def seconds_of(stamped: Column) -> Column:
    return unstamp(stamped)
