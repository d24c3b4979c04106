import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import util
from tidemark.llm.components import connected_components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)] + [(i, 500) for i in range(40, 45)], [(-5, 7), (7, 7), (7, -5), (9, 9)], "random"])
def test_against_union_find(spark, edges):
    if edges == "random":
        rng = random.Random(3)
        edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = plain([e for e in edges if e[0] != e[1]])
    rows = got.collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tables_in_the_shared_folder(spark):
    table = util.stored(spark.range(3).where("id > 5"), "nothing")
    assert table.columns == ["id"] and table.count() == 0 and table._stored_at.startswith(util.shared_dir(spark))
    util.discard(table)
    assert util.fresh(spark.createDataFrame([(1, 2)], "FP int, _fp int"), "fp") == "__fp"
    hashes = [r.h for r in spark.range(1000).select(util.unit_hash(F.col("id")).alias("h")).collect()]
    assert 0 <= min(hashes) and max(hashes) < 1 and 0.45 < sum(hashes) / 1000 < 0.55
