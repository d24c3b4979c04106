"""Categories, labels and texts made from events."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import CATEGORIES, CATEGORY


def category(event_type: Column) -> Column:
    """Category of an event type; null for an unknown one."""
    return F.element_at(F.create_map(*map(F.lit, chain(*CATEGORY.items()))), event_type)


def coarse(event_type: Column) -> Column:
    """Category by what a type's name contains; the name itself if it says nothing, ``unknown`` if it is empty."""
    has = lambda s: F.contains(event_type, F.lit(s))
    mouse = F.when(has("move"), "move").when(has("mouse_up") | has("mouse_down"), "click").when(has("scroll"), "scroll").otherwise("move")
    out = F.when(F.coalesce(event_type, F.lit("")) == "", "unknown").when(has("key"), "key").when(has("mouse"), mouse)
    for c in ("key", "click", "move", "scroll"):
        out = out.when(has(c), c)
    return out.otherwise(event_type)


def enabled(event_category: Column, disabled: list[str]) -> Column:
    """False for the disabled categories; names that are no category are ignored."""
    off = [c for c in disabled if c in CATEGORIES]
    return ~event_category.isin(off) if off else F.lit(True)


def is_mouse(event_type: Column) -> Column:
    return event_type.isin("mouse_click", "mouse_press", "mouse_release", "mouse_down")


def is_key(event_type: Column) -> Column:
    return event_type.isin("key_press", "key_release")


def is_scroll(event_type: Column) -> Column:
    return event_type == "mouse_scroll"


def is_move(event_type: Column) -> Column:
    return event_type == "mouse_move"


def button_name(button: Column) -> Column:
    return F.regexp_replace(button, r"^Button\.", "")


def key_name(key: Column) -> Column:
    return F.regexp_replace(key, r"^Key\.", "")


def scroll_direction(dx: Column, dy: Column) -> Column:
    """``up`` or ``down``, then ``right`` or ``left``; ``no scroll`` if neither moves."""
    said = F.concat_ws(" ", F.when(dy > 0, "up").when(dy < 0, "down"), F.when(dx > 0, "right").when(dx < 0, "left"))
    return F.when(said == "", "no scroll").otherwise(said)


def reason(event_category: Column, state: Column, why: Column) -> Column:
    return F.concat_ws("_", event_category, state, why)


def frame_name(seconds: Column, why: Column, extension: str = ".jpg") -> Column:
    return F.concat(F.format_string("%.6f", seconds), F.lit("_reason_"), why, F.lit(extension))


def unsigned_to_signed(number: Column) -> Column:
    """An unsigned 64-bit number, as decimal(20,0), to the long of the same bits."""
    half, whole = F.lit("9223372036854775807").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(number > half, (number - whole)).otherwise(number).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_key(path: Column) -> Column:
    """The last three parts of a path; the whole of a shorter one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 3, path).otherwise(F.array_join(F.slice(parts, -3, 3), "/"))


def actions(prompt: Column) -> Column:
    """The lines below ``Actions:`` of a prompt as bullets, one to a line; empty without any."""
    below = F.split(F.regexp_extract(prompt, r"(?s)Actions:[^\n]*\n(.*)", 1), "\n")
    lines = F.filter(F.transform(below, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.isin("", "No actions recorded."))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\u2022 "), x)), "\n")


def salvaged_json(text: Column) -> Column:
    """JSON text from a model's answer: all of it, else its longest part in braces or brackets, else the answer as it is."""
    part = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(valid(text), text).when((part != "") & valid(part), part).otherwise(text)


def sql_quoted(text: Column) -> Column:
    """A text made safe between single quotes: backslash, line ends, then the quote."""
    out = text
    for plain, safe in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("'", "\\'")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def data_url(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def transcript_line(number: Column, clock: Column, caption: Column) -> Column:
    return F.concat(F.lit("[ID: "), number, F.lit(" | Time: "), clock, F.lit("] "), caption)


def filled(template: str, logs: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{LOGS}}"), logs)


def button_colour(button: Column) -> Column:
    """The colour that marks a button in pictures."""
    # Colours by button.
    colours = {"left": "red", "right": "yellow", "middle": "green"}
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*colours.items()))), button_name(button)), F.lit("yellow"))


def opacity(age: Column, window: float) -> Column:
    return F.greatest(F.lit(0.3), 1 - age / window * 0.7)


def bar_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.5))
