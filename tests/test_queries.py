"""Every registered query with SQL returns the rows that DuckDB returns for it."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import function_queries, label_queries, log_queries, record_queries, source_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df, columns):
    number = lambda v: round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v
    return sorted(str([None if pd.isna(v) else number(v) for v in row]) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)


def test_carried_cursor(spark):
    """Without SQL: the same fold over rows on the driver."""
    from tidemark.operators.cursor import leaving
    from tidemark.plans.label_queries import _acted

    days = {}
    for r in sorted(_acted(spark, SF).collect(), key=lambda r: (r.session_id, r.ts, r.event_id)):
        days.setdefault((r.session_id, r.ts // 86_400_000_000), []).append({"cursor_position": r.cursor_position, "monitor": r.monitor.asDict()})
    want, key, pending = {}, None, []
    for (session, day), events in sorted(days.items()):
        pending = pending if session == key else []
        monitor, key = events[0]["monitor"], session
        events = pending + events
        want[session, day] = len(events)
        pending = leaving(events, monitor)
    got = {(r.session_id, r.day): r.n_events for r in QUERIES["carried_cursor"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert {f.name for f in entry.entry(spark).schema} >= {"session_id", "burst_id"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tidemark(\.| import )llm", p.read_text()), p
