"""Record layouts, as Spark DDL."""

MONITOR = "struct<left:int,top:int,width:int,height:int>"
DETAILS = "struct<x:double,y:double,dx:int,dy:int,button:string,key:string,double_click:boolean,accessibility:string,focused_element:string>"
EVENT_STRUCT = f"struct<timestamp:double,monitor_index:int,monitor:{MONITOR},event_type:string,details:{DETAILS},cursor_position:array<double>>"
EVENT = f"timestamp double, monitor_index int, monitor {MONITOR}, event_type string, details {DETAILS}, cursor_position array<double>"
SCREENSHOT = "timestamp double, path string, monitor_index int"
AGGREGATION = (
    "timestamp double, reason string, event_type string, request_state string, screenshot_path string, screenshot_timestamp double, "
    f"end_screenshot_timestamp double, num_events int, events array<{EVENT_STRUCT}>, cursor_position array<double>, monitor {MONITOR}, burst_id bigint, scale_factor double"
)
CAPTION = "start string, end string, start_seconds double, end_seconds double, caption string, chunk_index int"
MATCHED = (
    f"start_time double, end_time double, start_index int, end_index int, img string, caption string, raw_events array<{EVENT_STRUCT}>, "
    "num_aggregations int, start_formatted string, end_formatted string, scale_factor double"
)
RESPONSE = "array<struct<start:string,end:string,caption:string,description:string>>"

# The categories of input events, and the thresholds of the two presets in microseconds.
CATEGORY = {"mouse_down": "click", "mouse_up": "click", "mouse_move": "move", "mouse_scroll": "scroll", "key_press": "key", "key_release": "key"}
CATEGORIES = ("click", "move", "scroll", "key")
PRESETS = {
    "accurate": {"click": (200_000, 300_000), "move": (500_000, 4_000_000), "scroll": (500_000, 3_000_000), "key": (500_000, 6_000_000)},
    "rough": {"click": (800_000, 1_200_000), "move": (2_000_000, 16_000_000), "scroll": (2_000_000, 12_000_000), "key": (2_000_000, 24_000_000)},
}
PADDING_US = 75_000
EMISSION_DELAY = "3 seconds"
