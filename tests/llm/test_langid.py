import zlib
from collections import Counter

import numpy as np

from tidemark.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other thing is that they were there with them"
DE = "der schnelle braune fuchs springt über den faulen hund und dann ist das andere ding dass sie nicht da waren"
ES = "el rápido zorro marrón salta sobre el perro perezoso y luego la otra cosa es que ellos no estaban allí"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    run = " " + " ".join(words) + " "
    grams = Counter(c for c in run if c != " ")
    for n in (2, 3):
        grams.update(run[i : i + n] for i in range(len(run) - n + 1))
    return grams


def key(gram):
    k = 0
    for c in gram:
        k = k << 21 | (1 if c == " " else ord(c))
    return k


def test_ngrams_against_a_counter():
    for text in ["", "  123 !", "a", "Ab, ab!", EN, DE, ES, "漢字 かな 🎉 x", "ß İ ﬁ", "é" * 50, "x y " * 3000]:
        keys, counts = langid.ngrams(text)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {key(g): n for g, n in plain_ngrams(text).items()}
        assert (np.diff(keys) > 0).all()


def plain_predict(profiles, text, most):
    mine = sorted(plain_ngrams(text).items(), key=lambda g: (-g[1], key(g[0])))[:most]
    if not mine or not profiles:
        return "und", 0.0
    away = {}
    for lang, profile in profiles.items():
        rank = {g: i for i, g in enumerate(profile)}
        away[lang] = sum(abs(rank[g] - i) if g in rank else most for i, (g, _) in enumerate(mine))
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (most * len(mine))


def documents(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        lang, text = [("en", EN), ("de", DE), ("es", ES)][i % 3]
        words = text.split()
        rows.append((i, " ".join(rng.choice(words, 12)), lang if i % 7 else None, 0.5))
    rows += [(900, None, "en", 0.1), (901, "", None, 0.1), (902, "1234 !?", "de", 0.2), (None, EN, "en", None), (3, DE, "de", 0.0), (3, DE, "de", 0.0), (903, (ES + " ") * 3000, None, 0.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_predictions_against_plain_profiles(spark):
    rows, docs = documents(spark)
    out = langid.identify(docs, most=60).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    sums = {}
    for i, text, lang, _ in rows:
        if lang is not None and text is not None and not fold(i):
            sums.setdefault(lang, Counter()).update(plain_ngrams(text))
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda g: (-g[1], key(g[0])))[:60]] for lang, c in sums.items()}
    want = sorted((str(i), fold(i), *plain_predict(profiles, text or "", 60)) for i, text, _, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in out) == want
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 240]
    right = sum(r.lang_pred == ("en", "de", "es")[r.doc_id % 3] for r in held)
    assert len(held) > 50 and right / len(held) > 0.97


def test_filter_keeps_clean_rows(spark):
    rows, docs = documents(spark)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (900, 901, 902))
    assert all(r.lang for r in kept.collect())


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(docs.limit(0)).collect() == []
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [1, 2]
    assert langid.keep_identified(docs.limit(0)).collect() == []
