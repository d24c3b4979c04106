"""Merge intervals, say what happened in them, and match captions to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import per_mille
from tidemark.functions.text import button_name, key_name, scroll_direction
from tidemark.functions.timefmt import clock_or_null, prefix_time


def merge_groups(rows: DataFrame, by: list[str], order: list[str], path: str, name: str = "group_no") -> DataFrame:
    """Number (from 1) the stretches of rows to be merged: those whose paths begin with the same time.

    Each row is compared with the merged one before it, which keeps its first
    row's path. A row without a path joins. If the first row of all has no path,
    every row joins it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col(path).isNotNull(), prefix_time(F.col(path)))
    known = rows.withColumn("_at", at)
    first_missing = F.first(F.col("_at").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.coalesce(~first_missing & (F.col("_at") != F.last("_at", ignorenulls=True).over(so_far)), F.lit(False)).cast("int")
    marked = known.withColumn("_begins", begins)
    return marked.withColumn(name, (F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("bigint")).drop("_at", "_begins")


def merged(rows: DataFrame, by: list[str], order: list[str], first: list[str], last: list[str], events: str | None = None, event_ts: str = "timestamp", path: str = "screenshot_path") -> DataFrame:
    """One row for each stretch of ``merge_groups``: columns ``first`` of its earliest row, ``last`` of its latest, ``num_merged``.

    ``events`` are concatenated in time order. The scale factor of merged rows is 1.
    """
    grouped = merge_groups(rows, by, order, path)
    place = F.struct(*order)
    out = [F.min_by(c, place).alias(c) for c in first] + [F.max_by(c, place).alias(c) for c in last] + [F.count("*").alias("num_merged")]
    if events:
        flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(events).alias("e")))), lambda x: x["e"]))
        out.append(F.transform(F.array_sort(F.transform(flat, lambda e: F.struct(e[event_ts].alias("t"), e.alias("e")))), lambda x: x["e"]).alias(events))
    if "scale_factor" in rows.columns:
        out.append(F.when(F.count("*") > 1, 1.0).otherwise(F.first("scale_factor")).alias("scale_factor"))
    return grouped.groupBy(*by, "group_no").agg(*out)


def reordered(rows: DataFrame, by: list[str], order: list[str], kind: str = "event_type", name: str = "position") -> DataFrame:
    """Number (from 1) rows so that within each block of moves and scrolls the scrolls come first; nothing else changes place."""
    w = Window.partitionBy(*by).orderBy(*order)
    loose = F.col(kind).isin("mouse_move", "mouse_scroll")
    begins = (~loose | ~F.coalesce(F.lag(loose).over(w), F.lit(False))).cast("int")
    blocks = rows.withColumn("_begins", begins).withColumn("_block", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    again = Window.partitionBy(*by).orderBy("_block", F.when(F.col(kind) == "mouse_move", 1).otherwise(0), *order)
    return blocks.withColumn(name, F.row_number().over(again)).drop("_begins", "_block")


def _keys_said(keys: Column, before_click: Column) -> Column:
    joined = F.array_join(keys, "|")
    return F.when(before_click, F.concat(F.lit("Key(s) pressed: "), joined)).when(F.size(keys) == 1, F.concat(F.lit("Key pressed: "), joined)).otherwise(F.concat(F.lit("Keys pressed: "), joined))


def actions(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """What happens in each group of events, one line for each action: ``by``, ``position``, ``action``.

    ``events`` have ``event_type``, ``details``, ``cursor_position`` and
    ``monitor``. Runs of one type become one action, clicks one each; keys are
    kept until a click, scroll or move, or the end. Releases say nothing but end
    a run. A run of keys counts its non-empty names only.
    """
    rows = reordered(events, by, order)
    w = Window.partitionBy(*by).orderBy("position")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | (F.col("position") == 1)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(back))
    flush = F.col("event_type").isin("mouse_down", "mouse_scroll", "mouse_move")
    rows = rows.withColumn("_flush", (flush & (F.col("_new") == 1)).cast("int"))
    rows = rows.withColumn("_after", F.sum("_flush").over(back))  # flushes so far, this row's own included
    key = F.when(F.col("event_type") == "key_press", F.nullif(key_name(F.coalesce(F.col("details.key"), F.lit("Key.unknown"))), F.lit("")))
    place = per_mille(F.col("cursor_position"), F.col("monitor"))
    click = F.concat(F.lit("Mouse clicked "), button_name(F.coalesce(F.col("details.button"), F.lit("Button.unknown"))), F.lit(" at "), place, F.when(F.coalesce(F.col("details.double_click"), F.lit(False)), " (double click)").otherwise(""))
    rows = rows.select(*by, "position", "event_type", "_run", "_after", key.alias("_key"), place.alias("_place"), F.when(F.col("event_type") == "mouse_down", click).alias("_click"), scroll_direction(F.col("details.dx"), F.col("details.dy")).alias("_way"))
    # the keys between two flushes are said before the second, in its manner
    spells = rows.groupBy(*by, "_after").agg(F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("position", "_key")))).alias("_keys"), F.min("position").alias("_at"), F.min_by("event_type", "position").alias("_type"))
    then = Window.partitionBy(*by).orderBy("_after")
    spells = spells.withColumn("_at", F.lead("_at").over(then)).withColumn("_before_click", F.coalesce(F.lead("_type").over(then) == "mouse_down", F.lit(False))).where(F.size("_keys") > 0)
    said = spells.select(*by, F.coalesce(F.col("_at") - 0.5, F.lit(float("inf"))).alias("position"), _keys_said(F.transform("_keys", lambda x: x["_key"]), F.col("_before_click")).alias("action"))
    ran = rows.where(F.col("event_type").isin("mouse_down", "mouse_scroll", "mouse_move")).groupBy(*by, "_run").agg(
        F.min("position").alias("_at"),
        F.count("*").alias("_n"),
        F.first("event_type").alias("_type"),
        F.min_by("_way", "position").alias("_way"),
        F.min_by("_place", "position").alias("_from"),
        F.max_by("_place", "position").alias("_to"),
        F.collect_list(F.when(F.col("event_type") == "mouse_down", F.struct(F.col("position").cast("double").alias("position"), F.col("_click").alias("action")))).alias("_clicks"),
    )
    moved = F.when(F.col("_type") == "mouse_scroll", F.concat(F.lit("Scrolled "), F.col("_way"))).when(F.col("_n") >= 2, F.concat(F.lit("Mouse moved from "), F.col("_from"), F.lit(" to "), F.col("_to"))).otherwise(F.concat(F.lit("Mouse moved to "), F.col("_to")))
    each = F.when(F.col("_type") == "mouse_down", F.col("_clicks")).otherwise(F.array(F.struct(F.col("_at").cast("double").alias("position"), moved.alias("action"))))
    return said.unionByName(ran.select(*by, F.explode(each).alias("x")).select(*by, "x.position", "x.action"))


def prompts(events: DataFrame, by: list[str], order: list[str], time: Column) -> DataFrame:
    """The prompt of each group of events: ``by``, ``prompt``. ``time`` is an expression of ``by``."""
    lines = actions(events, by, order).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "action"))).alias("_lines"))
    place = per_mille(F.col("cursor_position"), F.col("monitor"))
    ends = events.groupBy(*by).agg(F.count("*").alias("_n"), F.min_by(place, F.struct(*order)).alias("_from"), F.max_by(place, F.struct(*order)).alias("_to"))
    cursor = F.when(F.col("_n") > 1, F.concat(F.lit("Cursor positions: "), F.coalesce("_from", F.lit("None")), F.lit(" to "), F.coalesce("_to", F.lit("None")))).otherwise(F.concat(F.lit("Cursor position: "), F.coalesce("_from", F.lit("None"))))
    said = F.when(F.size("_lines") > 0, F.concat(F.lit("\t"), F.array_join(F.transform("_lines", lambda x: x["action"]), "\n\t"))).otherwise("No actions recorded.")
    text = F.concat(F.lit("\n    "), time, F.lit(" Event:\n    "), cursor, F.lit("\n    Actions:\n    "), said, F.lit("\n        "))
    return ends.join(lines, by, "left").select(*by, text.alias("prompt"))


def parsed_captions(answers: DataFrame, answer: str, chunk_start: str, keep: list[str]) -> DataFrame:
    """Captions in a model's answers (JSON lists): ``keep``, ``position``, ``start_seconds``, ``end_seconds``, ``caption``.

    Times are ``MM:SS`` in the chunk. A bad start counts as 0, a bad end as the
    start; the text is ``caption``, else ``description``, else empty. What isn't
    a list has no captions.
    """
    items = F.from_json(F.col(answer), "array<struct<start:string,end:string,caption:string,description:string>>")
    rows = answers.select(*keep, chunk_start, F.posexplode(F.when(F.substring(F.trim(F.col(answer)), 1, 1) == "[", items)).alias("position", "c"))
    rows = rows.withColumn("_start", F.coalesce(clock_or_null(F.col("c.start")), F.lit(0)))
    rows = rows.withColumn("_end", F.coalesce(clock_or_null(F.col("c.end")), F.col("_start")))
    return rows.select(*keep, "position", (F.col(chunk_start) + F.col("_start")).alias("start_seconds"), (F.col(chunk_start) + F.col("_end")).alias("end_seconds"), F.coalesce("c.caption", "c.description", F.lit("")).alias("caption"))


def match_captions(captions: DataFrame, rows: DataFrame, session: str, order: list[str], caption_order: list[str], fps: int = 1, attach_tail: bool = True) -> DataFrame:
    """Captions with the range of a session's ``rows`` they cover: ``start_index``, ``end_index`` (from 0), ``n_rows``.

    A second is ``fps`` rows; indices are cut off to whole ones and kept within
    the rows, the end no earlier than the start. With ``attach_tail``, rows
    that no caption covers and that come after the last caption's range go to
    that caption, whose end becomes the last row: ``n_rows`` counts them.
    Captions of sessions without rows are left out.
    """
    sizes = rows.groupBy(session).agg(F.count("*").alias("_n"))
    found = captions.join(sizes, session)
    within = lambda c: F.greatest(F.lit(0), F.least((F.col(c) * fps).cast("int"), F.col("_n").cast("int") - 1))
    found = found.withColumn("start_index", within("start_seconds"))
    found = found.withColumn("end_index", F.greatest(F.col("start_index"), F.least((F.col("end_seconds") * fps).cast("int"), F.col("_n").cast("int") - 1)))
    found = found.withColumn("n_rows", F.col("end_index") - F.col("start_index") + 1)
    if not attach_tail:
        return found.drop("_n")
    # how far the captions reach beyond the last one, and how many rows after it nothing covers
    w = Window.partitionBy(session).orderBy(*caption_order)
    found = found.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    last = found.where("_last").select(session, F.col("end_index").alias("_end"), F.col("_n").alias("_size"))
    # ranges beyond that end, by their beginnings: each covers what lies behind the farthest end before it
    low, by_begin = F.greatest(F.col("start_index"), F.col("_end") + 1), Window.partitionBy(session).orderBy("_low", "end_index")
    beyond = found.join(last, session).where(F.col("end_index") > F.col("_end")).withColumn("_low", low)
    reach = F.coalesce(F.max("end_index").over(by_begin.rowsBetween(Window.unboundedPreceding, -1)), F.col("_end"))
    covered = beyond.withColumn("_new", F.greatest(F.lit(0), F.col("end_index") - F.greatest(F.col("_low") - 1, reach))).groupBy(session).agg(F.sum("_new").alias("_covered"))
    free = last.join(covered, session, "left").select(session, (F.col("_size") - 1 - F.col("_end") - F.coalesce("_covered", F.lit(0))).cast("int").alias("_free"))
    found = found.join(free, session)
    grows = F.col("_last") & (F.col("_free") > 0)
    return found.withColumn("n_rows", F.when(grows, F.col("n_rows") + F.col("_free")).otherwise(F.col("n_rows"))).withColumn("end_index", F.when(grows, F.col("_n").cast("int") - 1).otherwise(F.col("end_index"))).drop("_n", "_last", "_free")


def matched_ends(matches: DataFrame, rows: DataFrame, session: str, order: list[str], take: list[str]) -> DataFrame:
    """Captions with the columns ``take`` of the first and the last row of their range, as ``first_...`` and ``last_...``.

    A caption looks up two rows, however many it covers: their number is the
    difference of its indices, and rows of a session are in order of time.
    """
    at = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    numbered = rows.select(session, at.alias("_at"), *take)
    ends = lambda end: numbered.select(session, F.col("_at").alias(f"{end}_index"), *(F.col(c).alias(f"{'first' if end == 'start' else 'last'}_{c}") for c in take))
    return matches.join(ends("start"), [session, "start_index"]).join(ends("end"), [session, "end_index"])


def matched_rows(matches: DataFrame, rows: DataFrame, session: str, order: list[str], take: list[str], block: int = 1024) -> DataFrame:
    """Every row that a caption's index range covers: the caption's columns, ``row_index`` and the row's columns ``take``.

    Ranges and rows meet by blocks of ``block`` rows: a caption is sent to the
    blocks that it touches, and there compared with their rows. Where only the
    ends of a range count, ``matched_ends`` makes no such rows.
    """
    at = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    numbered = rows.withColumn("row_index", at).select(session, "row_index", *take).withColumn("_block", F.floor(F.col("row_index") / block))
    blocks = F.sequence(F.floor(F.col("start_index") / block), F.floor(F.col("end_index") / block))
    met = matches.withColumn("_block", F.explode(blocks)).join(numbered, [session, "_block"])
    return met.where(F.col("row_index").between(F.col("start_index"), F.col("end_index"))).drop("_block")


def captions_of_sessions(captions: DataFrame, session: str) -> DataFrame:
    """How many captions each session has: ``session``, ``n_captions``."""
    return captions.groupBy(session).agg(F.count("*").alias("n_captions"))
