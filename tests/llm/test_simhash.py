import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def plain_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = ["", None, "  \t\n", "One", "one", "a b", "a B c", "x y z x y z x y z", "Ünï CÖDE words here É", "w " * 5000, "a b c d e f g"]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_components_against_all_pairs(spark, distance):
    rng = random.Random(7)
    fps = [0, (1 << 64) - 1]
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains of small steps
            fps.append(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    ids = rng.sample(range(1000), len(fps))
    marked = spark.createDataFrame([(i, signed(f)) for i, f in zip(ids, fps, strict=True)], "id long, fp long")
    classes = {r.fp: r.component_id for r in simhash.components(marked, "id", distance).collect()}
    assert {i: classes[signed(f)] for i, f in zip(ids, fps, strict=True)} == plain_components(fps, ids, distance)


def test_groups_and_odd_rows(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(3, "One", "y", 1), (None, "one", None, None), (None, "q r s t", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rid int")
    out = simhash.simhash_groups(docs).collect()
    assert len(out) == len(rows)
    got = sorted((r.fingerprint, r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in out)
    wide = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    comp = plain_components(list(wide.values()), list(wide), 2)
    own = {f"{plain_fingerprint('one'):016x}": 3, f"{plain_fingerprint('q r s t'):016x}": -1}
    want = [(f"{plain_fingerprint(r[1]):016x}", r[0], comp[r[0]]) for r in rows if r[0] is not None]
    want += [(k, -1, v) for k, v in own.items()]
    assert got == sorted(want)


def test_dedup_keeps_one_row_of_each(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (5, "other words of text"), (None, None), (None, None), (None, "zz yy xx")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rid string")
    out = simhash.simhash_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "a b c d", "k"), (5, "other words of text", "k"), (None, None, "k"), (None, "zz yy xx", "k")]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == []
    assert simhash.simhash_dedup(docs).collect() == []


def test_links_at_distance_one(spark):
    """Two bits apart must not count, and a chain of single bits must."""
    fps = [0b1100, 0b1101, 0b0100, 0b1001, 1 << 40, (1 << 40) + 3]
    links = {(r.a, r.b) for r in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), 1).collect()}
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() == 1}
    assert links and links <= want and {frozenset(x) for x in links} == {frozenset(x) for x in want}


def test_manhattan(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice([rng.getrandbits(64), 0, (1 << 64) - 1]) - (1 << 63) for _ in "xy") for _ in range(300)]
    counts = lambda v: [((v % (1 << 64)) >> 4 * j & 15).bit_count() for j in range(16)]
    for r in spark.createDataFrame(rows, "x long, y long").select("x", "y", simhash.manhattan(simhash.popcounts(F.col("x")), simhash.popcounts(F.col("y"))).alias("m")).collect():
        assert r.m == sum(abs(a - b) for a, b in zip(counts(r.x), counts(r.y), strict=True)) <= ((r.x ^ r.y) % (1 << 64)).bit_count()


def edited(words, edits, rng):
    own = list(words)
    for at in rng.sample(range(len(own)), edits):
        own[at] = f"x{rng.randrange(10**6)}"
    return " ".join(own)


def test_near_dedup_against_all_pairs(spark):
    """Near copies of all degrees around the threshold: links only where shingles say so, and nearly all of these."""
    from tests_llm_plain import plain_near

    rng = random.Random(8)
    rows = []
    for _ in range(150):
        base = rng.choices([f"w{i}" for i in range(900)], k=rng.choice([40, 150, 400]))
        rows += [" ".join(base)] + [edited(base, max(1, round(len(base) * share)), rng) for share in rng.choices([0.0, 0.005, 0.01, 0.015, 0.02, 0.05], k=3)]
    rows += ["", None, " \n", "one two", "One  TWO", "one two three"] + ["hot copy of a text that many have"] * 200
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(rows)], "doc_id long, text string, rid int, s0 string")
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = plain_near(rows, range(len(rows)))
    groups = {want[i] for i in kept}
    assert len(kept) == len(set(kept)) and groups == set(want.values())  # no group is lost
    assert set(want.values()) <= set(kept)
    assert len(kept) - len(groups) <= 0.05 * (len(rows) - 200 - len(groups))  # and nearly all copies go
    assert simhash.near_dedup(docs.limit(0)).collect() == []


def test_near_copies_within_crowded_keys(spark, monkeypatch):
    """Keys of three bits hold many unlike texts: near copies among them meet, though they are not a key's smallest or largest."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        base = rng.choices([f"w{i}" for i in range(900)], k=200)
        rows += [" ".join(base), edited(base, 1, rng)]
    monkeypatch.setattr(simhash, "BLOCK", 5, raising=False)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = simhash.near_dedup(docs, near=simhash.Near(spare=-4, tries=20.0))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 120, 2))


def test_crowd_of_unlike_edits(spark, monkeypatch):
    """Copies of one text, each edited too much to be near another, share all keys: few of their pairs leave a task, and near ones among them are found."""
    from tests_llm_plain import plain_near

    rng = random.Random(12)
    base, rows = [f"w{i}" for i in rng.choices(range(900), k=150)], []
    for i in range(160):
        rows.append(edited(base, rng.randint(7, 10), rng))
        if i % 4 == 0:
            rows.append(edited(rows[-1].split(), 1, rng))
    counts, store = {}, simhash.stored

    def counted(df, label):
        out = store(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.near_dedup(docs, near=simhash.Near(spare=-4, tries=20.0)).collect())
    assert kept == sorted(set(plain_near(rows, range(len(rows))).values())) and len(kept) == 160
    assert counts["dealt"] > 0 and counts["met"] <= 2 * len(rows)


def test_sketch_distance(spark):
    """Never more than the number of shingles in one text alone, also where counts end at 255."""
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 90_000):
        one = np.unique(rng.integers(-(1 << 31), 1 << 31, n, dtype=np.int64).astype(np.int32))
        two = np.unique(np.concatenate([one[len(one) // 5 :], rng.integers(-(1 << 31), 1 << 31, n // 4, dtype=np.int64).astype(np.int32)]))
        a, b = (np.frombuffer(simhash.sketch(x), np.uint8).astype(int) for x in (one, two))
        assert len(a) == simhash.SKETCH and np.abs(a - b).sum() <= len(np.setxor1d(one, two))
        assert a.sum() == len(one) or n == 90_000 and a.max() == 255


def test_near_recall_on_documents(spark):
    """Against all pairs of the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from tests_llm_plain import plain_near

    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = plain_near([r.text for r in rows], [r.doc_id for r in rows])
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert set(want.values()) <= kept and len(kept) - len(set(want.values())) <= 2
