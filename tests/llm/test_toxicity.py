"""The chain against sums over all tag strings, places of spans, and held-out accuracy of the query."""

import itertools
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity


def plain_marginals(emission, first, change):
    """Weights of every tag string, summed."""
    n, on, total = len(emission), np.zeros(len(emission)), 0.0
    pairs = np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        follows = [(tags[i - 1], tags[i]) for i in range(n) if not first[i]]
        w = math.exp(sum(e for e, t in zip(emission, tags, strict=True) if t) + sum(change[a][b] for a, b in follows))
        total += w
        on += w * np.array(tags)
        for a, b in follows:
            pairs[a, b] += w
    return np.log(on / (total - on)), pairs / total


@pytest.mark.parametrize("block, part", [(64, 1 << 18), (2, 1 << 18), (3, 4), (2, 1)])
def test_marginals_against_all_strings(monkeypatch, block, part):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "PART", part)
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 10):
        change = tuple(map(tuple, rng.normal(size=(2, 2))))
        emission, first = rng.normal(size=n) * 3, rng.random(n) < 0.3
        first[0] = True
        odds, pairs = toxicity.Field(change=change).marginals(emission, first)
        want, want_pairs = plain_marginals(emission, first, change)
        assert np.allclose(odds, want) and np.allclose(pairs, want_pairs)


def test_gradient_is_the_likelihoods():
    """One step of the fit moves each parameter as the difference quotient of the plain log-likelihood says."""
    rng = np.random.default_rng(2)
    emission, first, tags = rng.normal(size=7), np.array([1, 0, 0, 1, 0, 0, 0], bool), np.array([0, 1, 1, 0, 0, 1, 0])
    change = rng.normal(size=(2, 2))

    def likelihood(shift, c):
        score = lambda t: sum((emission[i] + shift) * t[i] for i in range(7)) + sum(c[t[i - 1]][t[i]] for i in range(7) if not first[i])
        return score(tags) - math.log(sum(math.exp(score(t)) for t in itertools.product((0, 1), repeat=7)))

    odds, pairs = toxicity.Field(change=tuple(map(tuple, change))).marginals(emission, first)
    assert math.isclose((tags - 1 / (1 + np.exp(-odds))).sum(), (likelihood(1e-5, change) - likelihood(-1e-5, change)) / 2e-5, rel_tol=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        up, down = change.copy(), change.copy()
        up[a, b] += 1e-5
        down[a, b] -= 1e-5
        observed = sum(tags[i - 1] == a and tags[i] == b for i in range(7) if not first[i])
        assert math.isclose(observed - pairs[a, b], (likelihood(0, up) - likelihood(0, down)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)


@given(st.text(alphabet="abcÄßİ 1.\n𝔸é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_features_do_not_depend_on_pieces(text):
    data = np.frombuffer(toxicity.lowered(text).encode() + b" ", np.uint8)
    begin, end = toxicity.words(data)
    whole = toxicity.features(data, begin, end)
    parts = [toxicity.features(data[a:b], *toxicity.words(data[a:b])) for a, b in toxicity.pieces(data, 7)]
    assert (np.concatenate(parts, axis=1) == whole).all() if parts else not len(begin)
    same = {}
    for a, b, column in zip(begin, end, whole.T, strict=True):
        assert same.setdefault(bytes(data[a:b]), tuple(column)) == tuple(column)


def toy(n=400):
    """Half of the documents of one kind hold a bad word, or one of a bad family; the other words are alike."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("aeiounrst"), rng.integers(2, 9)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.integers(5, 60))], i % 4 == 0
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words)), str(rng.choice(["Zonk", "bläh", "ploxi" + word()])))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_spans_and_scores(spark):
    rows = toy()
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    docs = [(1, "𝔸 reas ZONK tias."), (2, "nothing a rio"), (3, ""), (4, None), (5, "12 . -"), (6, "rote " * 60000 + "bläh tone"), (1, "𝔸 reas ZONK tias."), (None, "an ploxitera")]
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "id long, text string, score string, predicted int")
    out = toxicity.with_toxicity(frame, model).collect()
    found = [(r.id, r.predicted, [r.text[s.start : s.end] for s in r.spans]) for r in out]
    bad = [(1, 1, ["ZONK"]), (2, 0, []), (3, 0, []), (4, 0, []), (5, 0, []), (6, 1, ["bläh"]), (1, 1, ["ZONK"]), (None, 1, ["ploxitera"])]
    assert sorted(found, key=str) == sorted(bad, key=str)
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in out)
    assert all(0.5 <= s.marginal <= 1 for r in out for s in r.spans)
    assert toxicity.with_toxicity(frame.limit(0), model).collect() == []


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0"), labels.where("toxic is null")):
        out = toxicity.score_documents(docs, some).collect()
        assert sorted((r.doc_id or 0, r.held_out) for r in out) == sorted((i or 0, zlib.crc32(str(i or "").encode()) % 5 == 0) for i in (1, 2, 2, None, 3))
        assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in out)
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op12_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.score >= 0.5) == r.predicted for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right, found, toxic = (sum(p and y for p, y in held), sum(p for p, _ in held), sum(y for _, y in held))
    assert right >= 0.8 * toxic and right >= 0.9 * found
