"""Registered queries take every row and whole texts: against plain Python over small tables."""

import base64
import datetime as dt

import pytest

from tidemark.plans import function_queries, label_queries, record_queries  # noqa: F401
from tidemark.plans.registry import QUERIES

EPOCH = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Session 1 has no event id that 5 divides, session 2 a few, session 3 one event and session 4 none."""
    folder = str(tmp_path_factory.mktemp("whole"))
    ids = {1: [1, 2, 3, 4, 6, 7, 8, 9, 11, 12], 2: list(range(20, 43)), 3: [101]}
    types = ["view", "click", "view", "purchase", "error", "signup"]
    events = [(i, EPOCH + dt.timedelta(hours=i * 7 % 50), user, types[i % 6], f'{{"k": {i * 13 % 100}}}') for user, own in ids.items() for i in own]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    turns = [(conv, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of conversation {conv}: " + "größer, länger " * (conv * 3 + t) + f"the end {t}") for conv in (1, 2, 3, 4) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder, events, turns


def matched(events, turns):
    """Captions of sessions with events: (session, turn, text, start, end), and the sessions' events in order."""
    rows = {}
    for e in sorted(events, key=lambda e: (e[2], e[1], e[0])):
        rows.setdefault(e[2], []).append(e)
    out = []
    for conv, turn, _, text in turns:
        if conv in rows:
            last = len(rows[conv]) - 1
            start = min(turn * 2, last)
            out.append((conv, turn, text, start, max(start, min(turn * 2 + len(text) % 4, last))))
    return out, rows


def test_captions_match_all_events(spark, tables):
    folder, events, turns = tables
    want, rows = matched(events, turns)
    got = {(r.session_id, r.turn): (r.start_index, r.end_index, r.n_rows) for r in QUERIES["caption_match_raw"](spark, folder).collect()}
    assert got == {(s, t): (a, b, b - a + 1) for s, t, _, a, b in want}
    got = {(r.session_id, r.turn): (r.num_aggregations, r.start_ts, r.end_ts, r.img) for r in QUERIES["caption_match"](spark, folder).collect()}
    us = lambda e: (e[1] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert got == {(s, t): (b - a + 1, us(rows[s][a]), us(rows[s][b]), rows[s][a][0]) for s, t, _, a, b in want}
    tails = {}
    for s, t, _, a, b in want:
        free = [i for i in range(b + 1, len(rows[s])) if not any(x[0] == s and x[3] <= i <= x[4] for x in want)] if t == 5 else []
        tails[s, t] = (a, len(rows[s]) - 1 if free else b, b - a + 1 + len(free))
    got = {(r.session_id, r.turn): (r.start_index, r.end_index, r.n_rows) for r in QUERIES["caption_tail_attach"](spark, folder).collect()}
    assert got == tails and any(tails[k][2] > 1 for k in tails)


def test_captions_are_whole_texts(spark, tables):
    folder, events, turns = tables
    by_turn = {(s, t): text for s, t, _, text in turns}
    assert min(map(len, by_turn.values())) > 12
    got = {(r.session_id, r.turn): r.caption for r in QUERIES["caption_match_raw"](spark, folder).collect()}
    assert got == {k: v for k, v in by_turn.items() if k[0] != 4}
    for r in QUERIES["dataset_format2"](spark, folder).collect():
        assert r.text == by_turn[r.session_id, r.turn]
    got = {(r.session_id, r.event_no): r.caption for r in QUERIES["sanitized_captions"](spark, folder).collect()}
    assert got == {(s, t): "[removed]" if t % 3 == 1 else text for (s, t), text in by_turn.items()}
    got = {(r.session_id, r.event_no): r.caption for r in QUERIES["noise_events"](spark, folder).collect()}
    assert got == {(s, t): text for (s, t), text in by_turn.items() if t == 3}
    got = {(r.session_id, r.task_id): r.captions for r in QUERIES["task_groups"](spark, folder).collect()}
    assert got == {(s, task): "|".join(by_turn[s, t] for t in own) for s in (1, 2, 3, 4) for task, own in (("a", (0, 2, 4)), ("b", (1, 2, 5)))}
    got = {r.session_id: r.transcript for r in QUERIES["transcript"](spark, folder).collect()}
    assert got == {s: "\n".join(f"[ID: {t} | Time: 00:{t * 2:02d}] {by_turn[s, t]}" for t in range(6)) for s in (1, 2, 3, 4)}


def test_functions_of_whole_texts(spark, tables):
    folder, _, turns = tables
    got = {(r.conv_id, r.turn): (r.url, r.filled) for r in QUERIES["text_functions"](spark, folder).collect()}
    assert got == {(s, t): ("data:text/plain;base64," + base64.b64encode(text.encode()).decode(), f"Log: {text}.") for s, t, _, text in turns}


def test_reconstructed_gathers_no_session(spark, tables):
    folder, events, _ = tables
    out = QUERIES["reconstructed"](spark, folder)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "raw_events" not in plan
    _, rows = matched(events, [])
    seconds = lambda e: (e[1] - dt.datetime(1970, 1, 1)) / dt.timedelta(seconds=1)
    left = lambda e: 0 if e[0] * 13 % 100 % 3 == 0 else 1000
    assert {(r.session_id, r.n_events, r.timestamp, r.monitor_left, r.event_type) for r in out.collect()} == {(s, len(own), seconds(own[0]), left(own[0]), "mixed") for s, own in rows.items()}


def test_reconstructed_aggregations(spark):
    from tidemark.operators.cursor import reconstructed

    monitor = "struct<left:int>"
    rows = [("a", [("click", (7,)), ("view", (8,))], 1.0, 2.0, None), ("b", [], 1.0, 2.0, 0.5)]
    matched = spark.createDataFrame(rows, f"img string, raw_events array<struct<event_type:string,monitor:{monitor}>>, start_time double, end_time double, scale_factor double")
    got = reconstructed(matched).collect()
    assert [(r.screenshot_path, r.monitor.left, r.event_type, len(r.events), r.scale_factor) for r in got] == [("a", 7, "mixed", 2, 1.0)]
