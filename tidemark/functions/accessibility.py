"""What is known of the element under the cursor, as recorded JSON."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the platform's attributes and roles.
UNIVERSAL = ("AXRole", "AXRoleDescription", "AXTitle", "AXDescription", "AXIdentifier", "AXDOMIdentifier", "AXEnabled", "AXFocused")
OF_ROLE = {
    "AXButton": ("AXTitle", "AXDescription"),
    "AXCheckBox": ("AXTitle", "AXValue"),
    "AXRadioButton": ("AXTitle", "AXValue"),
    "AXTextField": ("AXTitle", "AXValue", "AXPlaceholderValue"),
    "AXTextArea": ("AXTitle", "AXValue", "AXSelectedText"),
    "AXStaticText": ("AXValue",),
    "AXLink": ("AXTitle", "AXURL", "AXVisited"),
    "AXImage": ("AXTitle", "AXDescription", "AXURL"),
    "AXMenuItem": ("AXTitle", "AXEnabled"),
    "AXPopUpButton": ("AXTitle", "AXValue"),
    "AXComboBox": ("AXTitle", "AXValue"),
    "AXSlider": ("AXTitle", "AXValue", "AXMinValue", "AXMaxValue"),
    "AXTab": ("AXTitle", "AXValue"),
}
TELLING = ("AXTitle", "AXDescription", "AXValue", "AXPlaceholderValue", "AXURL", "AXLabel")
GENERIC = ("AXImage", "AXGroup", "AXStaticText", "AXScrollArea", "AXUnknown", "AXCell")
INTERACTIVE = ("AXButton", "AXTextField", "AXTextArea", "AXCheckBox", "AXRadioButton", "AXLink", "AXMenuItem", "AXPopUpButton", "AXComboBox", "AXTab", "AXSlider")


def _told(element: Column, under: str = "$") -> Column:
    """Whether a telling attribute holds more than blanks (a zero or false value tells nothing, but a text of it does)."""
    out = F.lit(False)
    for name in TELLING:
        out = out | _says(F.try_variant_get(F.try_parse_json(element), f"{under}.{name}", "variant"), r"(?U)\S")
    return out


def _says(value: Column, filled: str) -> Column:
    """Whether a JSON value is neither missing, null, zero, false nor empty; a text must hold ``filled``, a pattern."""
    shown = F.try_variant_get(value, "$", "string")
    a_text = F.schema_of_variant(value) == "STRING"
    return F.coalesce(F.when(a_text, shown.rlike(filled)).otherwise(~shown.isin("false", "0", "0.0", "-0.0", "[]", "{}", "null")), F.lit(False))


def useful(element: Column) -> Column:
    """Whether an element's JSON says something: its own telling attributes, else its role, else its parent's attributes."""
    role = F.coalesce(F.get_json_object(element, "$.AXRole"), F.lit(""))
    return F.coalesce(F.when(_told(element), True).when(role.isin(*GENERIC), False).when(role.isin(*INTERACTIVE), True).otherwise(_told(element, "$._parent")), F.lit(False))


def projected(element: Column) -> Column:
    """An element's JSON with the universal attributes, its role's own, and its parent's role and title; null if none has a value."""
    values = lambda c: F.from_json(c, "map<string,variant>")
    said = lambda m: F.transform_values(F.map_filter(m, lambda k, v: _says(v, "(?s).")), lambda k, v: F.try_variant_get(v, "$", "string"))
    own = F.create_map(*chain.from_iterable((F.lit(r), F.array(*map(F.lit, names))) for r, names in OF_ROLE.items()))
    wanted = F.concat(F.array(*map(F.lit, UNIVERSAL)), F.coalesce(F.try_element_at(own, F.get_json_object(element, "$.AXRole")), F.array().cast("array<string>")))
    kept = F.map_filter(said(values(element)), lambda k, v: F.array_contains(wanted, k))
    parent = F.map_filter(said(values(F.get_json_object(element, "$._parent"))), lambda k, v: k.isin("AXRole", "AXTitle"))
    parent = F.when(F.size(parent) > 0, F.create_map(F.lit("_parent"), F.to_json(parent)))
    both = F.map_concat(kept, F.coalesce(parent, F.create_map().cast("map<string,string>")))
    return F.when(F.size(both) > 0, F.to_json(both))


def sampled(events: DataFrame, by: list[str], order: list[str], every: int = 10) -> DataFrame:
    """Which events an element is looked up for (``looked_up``): one move in ``every``; never releases; else each."""
    moves = F.row_number().over(Window.partitionBy(*by, "event_type").orderBy(*order))
    wanted = F.when(F.col("event_type") == "mouse_move", moves % every == 0).otherwise(~F.col("event_type").isin("mouse_up", "key_release"))
    return events.withColumn("looked_up", wanted)
