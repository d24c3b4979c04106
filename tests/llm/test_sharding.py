import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import sharding
from tidemark.llm.queries import sharding_sql


def plain(rows, limit):
    """Split one bucket after the other, from the root."""
    keyed = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]
    out, todo = {}, [(0, 0, keyed)]
    while todo:
        depth, prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) == 1:
            out[depth, prefix] = own
            continue
        for bit in (0, 1):
            half = [x for x in own if x[0] >> (59 - depth) & 1 == bit]
            if half:
                todo.append((depth + 1, prefix * 2 + bit, half))
    return out


@pytest.mark.parametrize("limit", [1, 300, 2000, 10**9])
def test_against_plain_splits(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "é" * rng.randint(0, 90)) for i in range(300)] + [(7, "x" * rng.choice([9, 30])) for _ in range(120)] + [(None, None), (None, "z" * 5000), (8, "same"), (8, "same")]
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, bytes int, h string").repartition(3)
    out = sharding.shards(docs, limit).collect()
    want = plain(rows, limit)
    got, full = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.depth, r.prefix].append(r.bytes)
        full[r.depth, r.prefix, r.part].append(r)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(n for _, n in v) for k, v in want.items()}
    assert sorted(str((r.doc_id, r.bytes)) for r in out) == sorted(str((i, len((t or "").encode()))) for i, t in rows)
    for own in full.values():
        total = sum(r.bytes for r in own)
        assert all(r.shard_bytes == total for r in own)
        assert total <= limit or len(own) == 1


def test_against_sql(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 60)) for i in range(500)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    assert sorted(tuple(r) for r in sharding.shards(docs, 1500).collect()) == sorted(con.execute(sharding_sql(1500)).fetchall())


def test_empty_table(spark):
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string"), 10).collect() == []
