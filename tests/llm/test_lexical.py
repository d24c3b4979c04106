"""Ranked search against a plain double loop, and against SQL over whole tables."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    documents = sum(bool(c) for _, c in counted)
    length = sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = {}
    for item, own in asked.items():
        found = []
        for i, c in counted:
            n, score = sum(c.values()), 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * documents // length)))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = i, -score
    return out


def got(df):
    rows = df.collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_against_a_double_loop(spark):
    rng = np.random.default_rng(2)
    words = [f"{w}{x}" for w in ("the", "Étoile", "zwölf", "x", "ñu", "数") for x in ("", "1", "ab", "Q", "é")]
    text = lambda n: "".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", "-", "_", ". "])) for _ in range(n))
    docs = [(i, text(int(n))) for i, n in enumerate(rng.geometric(0.03, 300))]
    docs += [(300 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (400, None), (401, ""), (402, "-- ."), (403, text(30000))]
    items = [(i, text(int(n))) for i, n in enumerate(rng.geometric(0.1, 30))] + [(3, "Étoile zwölf"), (None, "the x"), (90, None), (91, ""), (92, "absent")]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(7)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert got(lexical.search(left, right)) == want
    assert got(lexical.search(left, right, item_terms=20, block=500, parts=2)) == want  # blocks of either side change nothing


def test_repeats_count_as_often(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "a b b c c c")], "item_id long, text string")
    once, often = got(lexical.search(docs, items)), got(lexical.search(docs, items, repeats=True))
    assert once[0, 1][0] == 1 and often[0, 1][0] == 2
    a, b = lexical.weight(3, 1), lexical.weight(3, 2)
    share = lambda n: 10**9 // (1000 + 8 * (10 + 90 * n * 3 // 5))
    assert often == {(0, 1): (2, (2 * b + 3 * a) * share(2)), (0, 2): (1, (a + 2 * b) * share(2))}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.search(d, i).collect() == []


def test_query_against_sql(spark):
    import duckdb

    from tidemark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = {(r[0], r[1]): (r[2], r[3]) for r in con.execute(ORACLES["op13_lexical"]).fetchall()}
    assert got(QUERIES["op13_lexical"](spark, "/root/testdata/sf0.01")) == want and len(want) > 100
