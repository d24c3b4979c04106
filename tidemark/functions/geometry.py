"""Screens, cursor positions and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside(x: Column, y: Column, monitor: Column) -> Column:
    """Whether a point lies on a monitor; the right and lower edges are outside."""
    across = (x >= monitor["left"]) & (x < monitor["left"] + monitor["width"])
    return across & (y >= monitor["top"]) & (y < monitor["top"] + monitor["height"])


def monitor_at(x: Column, y: Column, monitors: Column, first: int = 0) -> Column:
    """Number of the first of an array of monitors that a point lies on, counted from ``first``; 0 if on none."""
    hits = F.transform(monitors, lambda m: inside(x, y, m))
    place = F.array_position(hits, True)
    return F.when(place > 0, place - 1 + first).otherwise(0).cast("int")


def per_mille(position: Column, monitor: Column) -> Column:
    """A cursor position in thousandths of its monitor, halves to even, as ``(x, y)`` text.

    Without a monitor the position itself; without a two-part position null.
    """
    at = lambda i, edge, size: F.bround((F.get(position, F.lit(i)) - monitor[edge]) / monitor[size] * 1000).cast("bigint")
    plain = F.format_string("(%s, %s)", F.get(position, F.lit(0)), F.get(position, F.lit(1)))
    scaled = F.format_string("(%d, %d)", at(0, "left", "width"), at(1, "top", "height"))
    return F.when(F.size(position) == 2, F.when(monitor.isNull(), plain).otherwise(scaled))


def to_image(x: Column, y: Column, monitor: Column, scale: Column) -> tuple[Column, Column]:
    """Screen to picture coordinates, cut off towards zero."""
    return ((x - monitor["left"]) * scale).cast("int"), ((y - monitor["top"]) * scale).cast("int")


def fitted(width: Column, height: Column, most_width: Column, most_height: Column) -> tuple[Column, Column]:
    """The largest size of the same shape within a box."""
    scale = F.least(most_width / width, most_height / height)
    return (width * scale).cast("int"), (height * scale).cast("int")


def shrunk(width: Column, height: Column, most: tuple[int, int]) -> tuple[Column, Column]:
    """A size within ``most`` (long side, short side), turned like the picture; never enlarged, at least 1."""
    long, short = F.lit(max(most)), F.lit(min(most))
    wide = width >= height
    scale = F.least(F.when(wide, long).otherwise(short) / width, F.when(wide, short).otherwise(long) / height, F.lit(1.0))
    side = lambda s: F.when(scale >= 1, s).otherwise(F.greatest(F.lit(1), F.bround(s * scale).cast("int")))
    return side(width), side(height)


def scaled(width: Column, height: Column, factor: Column) -> tuple[Column, Column]:
    """A size times a factor below 1, at least 1; any other factor leaves it."""
    side = lambda s: F.when(factor >= 1, s).otherwise(F.greatest(F.lit(1), F.bround(s * factor).cast("int")))
    return side(width), side(height)


def dpi(pixels: Column, millimetres: Column) -> Column:
    return pixels / (millimetres / 25.4)


def target_scale(dots: Column, target: float) -> Column:
    return F.lit(target) / dots


def scale_of(monitor_index: Column, scales: Column) -> Column:
    """The scale of a frame's monitor (counted from 1; 0 is all of them) from an array of scales."""
    return F.get(scales, F.greatest(monitor_index - 1, F.lit(0)))
