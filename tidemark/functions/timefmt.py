"""Timestamps in names and texts, clock readings and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK, DAY, HOUR = 7 * 86_400, 86_400, 3_600


def micros(seconds: Column) -> Column:
    """Epoch seconds as a whole number of microseconds, halves to even: the key by which records are compared."""
    return F.bround(seconds * 1_000_000).cast("bigint")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _clock(text: Column, digits: int) -> Column:
    found = F.regexp_extract(text, rf"(\d{{{digits}}})", 1)
    stamped = F.concat(F.substring(found, 1, 14), F.lit("."), F.rpad(F.substring(found, 15, 3), 3, "0"))
    return F.unix_micros(F.try_to_timestamp(stamped, F.lit("yyyyMMddHHmmss.SSS"))) / 1e6


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def frame_time(path: Column, modified: Column | None = None) -> Column:
    """Seconds from a frame's name: a leading decimal, else 17 digits of date and time, else ``modified``."""
    name = basename(path)
    return F.coalesce(_number(name, r"^(\d+\.\d+)"), _clock(name, 17), modified if modified is not None else F.lit(None).cast("double"))


def loose_time(path: Column, modified: Column) -> Column:
    """Seconds from the first decimal anywhere in the name, else ``modified``."""
    return F.coalesce(_number(basename(path), r"(\d+\.\d+)"), modified)


def listing_time(name: Column) -> Column:
    """Seconds from the first decimal in a name, else its 14 digits of date and time, else null."""
    return F.coalesce(_number(name, r"(\d+\.\d+)"), _clock(name, 14))


def prefix_time(path: Column) -> Column:
    """Seconds before the first underscore of a path's name; 0 if that is no number."""
    return F.coalesce(F.substring_index(basename(path), "_", 1).try_cast("double"), F.lit(0.0))


FRAME_NAME = r"(\d+\.\d+)_reason_(.+)\.[A-Za-z0-9]+$"


def frame_reason(path: Column) -> Column:
    """The reason written into a frame's name; null where there is none."""
    return F.nullif(F.regexp_extract(basename(path), FRAME_NAME, 2), F.lit(""))


def frame_category(path: Column) -> Column:
    """The first of click, move, scroll and key that the reason mentions."""
    out = F.lit(None).cast("string")
    for c in ("key", "scroll", "move", "click"):
        out = F.when(F.contains(frame_reason(path), F.lit(c)), c).otherwise(out)
    return out


def _clock_parts(text: Column) -> Column:
    return F.split(text, ":")


def clock_seconds(text: Column) -> Column:
    """``MM:SS`` to seconds, by its first two parts."""
    p = _clock_parts(text)
    return (F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")).cast("int")


def clock_or_null(text: Column) -> Column:
    """``MM:SS`` to seconds; null unless it has exactly two parts that are whole numbers."""
    p = _clock_parts(text)
    value = F.trim(F.get(p, F.lit(0))).try_cast("int") * 60 + F.trim(F.get(p, F.lit(1))).try_cast("int")
    return F.when(F.size(p) == 2, value)


def clock(seconds: Column) -> Column:
    """Seconds as ``MM:SS``; minutes may go past 59."""
    whole = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def stamp(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-mm-dd_HH-MM-SS-ffffff`` in the session's time zone, microseconds cut off."""
    us = F.floor(seconds * 1_000_000).cast("bigint")
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd_HH-mm-ss-"), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def unstamp(text: Column) -> Column:
    """The inverse of ``stamp``."""
    whole = F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd_HH-mm-ss"))
    return whole + F.substring(text, 21, 6).cast("int") / 1e6


def duration(text: str) -> int:
    """Seconds of ``2wk``, ``14d`` or ``48hr``; another text is an error."""
    m = re.fullmatch(r"(\d+)(wk|d|hr)", text.strip().lower())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"wk": WEEK, "d": DAY, "hr": HOUR}[m[2]]


def is_duration(text: str) -> bool:
    """Whether a three-part split is given by time and not by ratio: if any part has a unit of time."""
    parts = text.split(",")
    return len(parts) == 3 and any(re.fullmatch(r"\s*\d+(wk|d|hr)\s*", p, re.IGNORECASE) for p in parts)


def split_spec(text: str) -> list[int] | list[float]:
    """Three comma-separated durations in seconds, or three ratios that sum to 1 (0.99 to 1.01)."""
    parts = text.split(",")
    if len(parts) != 3:
        raise ValueError("a split has three parts")
    if is_duration(text):
        return [duration(p) for p in parts]
    ratios = [float(p) for p in parts]
    if not 0.99 <= sum(ratios) <= 1.01 or any(not 0 <= r <= 1 for r in ratios):
        raise ValueError("ratios lie between 0 and 1 and sum to 1")
    return ratios


def duration_text(seconds: int) -> str:
    """Seconds in weeks or days if they are whole ones, else in hours, cut off."""
    for unit, size in (("wk", WEEK), ("d", DAY)):
        if seconds >= size and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds // HOUR}hr"


def num_chunks(seconds: Column, length: int) -> Column:
    """How many chunks of ``length`` seconds a duration takes."""
    return F.ceil(seconds / F.lit(float(length))).cast("bigint")
