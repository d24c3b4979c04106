import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import mixing

DIMS = {"source": 0.5, "lang": 0.7, "topic": 0.6}


def plain(rows, keep):
    """Cells to probabilities, by the textbook loop."""
    cells = defaultdict(int)
    for _, *key, n in rows:
        cells[tuple("" if k is None else k for k in key)] += n
    cells = {c: n for c, n in cells.items() if n}
    total = sum(cells.values())
    weight = {c: n / total for c, n in cells.items()}
    targets = []
    for i, power in enumerate(DIMS.values()):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[i]] += n
        whole = sum(s**power for s in sums.values())
        targets.append({v: s**power / whole for v, s in sums.items()})
    for _ in range(200):
        for i, target in enumerate(targets):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[i]] += w
            weight = {c: w * target[c[i]] / sums[c[i]] for c, w in weight.items()}
    down, up = 0.0, 1e12
    for _ in range(200):
        mid = (down + up) / 2
        down, up = (mid, up) if sum(n * min(1, mid * weight[c] / n) for c, n in cells.items()) < keep * total else (down, mid)
    return {c: min(1, up * weight[c] / n) for c, n in cells.items()}


def documents(spark):
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(6)}"
        rows.append((i, source if i % 11 else None, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b"]), rng.randint(1, 400)))
    rows += [(None, "s1", "en", "a", 5), (None, "s1", "en", "a", 5), (2001, "empty", "xx", "z", 0), (5, "s2", "de", "b", 9), (5, "s2", "de", "b", 9)]
    return rows, spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, lang string, topic string, tokens long, source_key string")


@pytest.mark.parametrize("cells", [50_000, 3])
def test_against_plain_raking(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    rows, docs = documents(spark)
    out = mixing.mix(docs, DIMS, 0.6).collect()
    want = plain(rows, 0.6)
    assert len(out) == len(rows)
    for r in out:
        p = want.get(tuple(x or "" for x in (r.source, r.lang, r.topic)), 0.0)
        assert abs(r.probability - p) < 1e-4
        if r.doc_id is not None:
            chance = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 16**13
            assert r.sampled == (chance < r.probability)
    kept, total = sum(r.tokens for r in out if r.sampled), sum(r.tokens for r in out)
    assert abs(kept / total - 0.6) < 0.04


def test_margins_meet_their_targets(spark):
    _, docs = documents(spark)
    cells = docs.na.fill("").groupBy("source", "lang", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    targets = {d: mixing.tempered(cells, d, p) for d, p in DIMS.items()}
    fitted = mixing.rake(cells, targets).toPandas()
    for d, target in targets.items():
        got = fitted.groupby(d)["weight"].sum()
        for r in target.collect():
            assert abs(got.get(r[d], 0.0) - r.share) < 1e-4


def test_documents_with_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, tokens int, sampled string"
    docs = spark.createDataFrame([(1, None, None, None, 1, "a"), (2, "", "en", "s", 1, "b"), (3, "some words | here", "en", "s", None, "c"), (None, "more *** words", None, "s", 1, "d")], schema)
    out = {r.doc_id: r for r in mixing.mix_documents(docs, keep=1.0).collect()}
    assert [(out[i].topic, out[i].tokens, out[i].sampled) for i in (1, 2, 3, None)] == [("note", 0, False), ("note", 0, False), ("table", 4, True), ("markup", 3, True)]
    kept = mixing.keep_mixed(docs, keep=1.0)
    assert kept.columns == docs.columns and sorted(r.sampled for r in kept.collect()) == ["c", "d"]
    for f in (mixing.mix_documents, mixing.keep_mixed):
        assert f(docs.limit(0)).collect() == []
        assert f(docs.where("doc_id < 3")).count() in (0, 2)


def test_given_targets(spark):
    """Token shares of what stays come near the targets of a table; a value without target goes."""
    rows = [(i, ("a", "b", "c")[i % 3], "x" if i % 2 else "y", 10) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long")
    source = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, share double")
    lang = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, share double")
    kept = mixing.mix(docs, {"source": source, "lang": lang}, 0.3).where("sampled").groupBy("source", "lang").count().collect()
    total = sum(r["count"] for r in kept)
    share = lambda c, v: sum(r["count"] for r in kept if r[c] == v) / total
    assert abs(total - 1800) < 150 and abs(share("source", "a") - 0.75) < 0.03 and abs(share("lang", "x") - 0.5) < 0.03 and share("source", "c") == 0
