"""The pipeline against a plain run over the same documents, stage by stage."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_plain import chance, plain_mix, plain_near, plain_predict_all, plain_redact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int"


def documents():
    rng = random.Random(6)
    words = {"en": "the and of that with house river green they were there when would this from".split(), "de": "der die und das mit haus fluss grün waren dort wenn würde dieses über von".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choices(words[lang], k=rng.randint(5, 60)))
        if i % 9 == 0:
            text += f" write to a{i}@mail.example.com or +1 (523) 555-10{i % 90 + 10}"
        rows.append((i, text, lang if i % 5 else None, f"s{i % 4}", len(text), i))
    rows += [(200 + i, rows[i][1], "en", "hot", 1, i) for i in range(30)]
    rows += [(300, "", "en", "s1", 0, 0), (301, None, None, None, None, None), (302, "12 !? 34", "de", "s1", 8, 1), (303, "one two three | four five the and of " * 900, "en", "s2", 1, 2)]
    long = rng.choices(words["en"], k=300)
    for i, edits in ((400, 1), (401, 4), (402, 40)):  # near copies of 390, and one too far away
        own = list(long)
        for at in rng.sample(range(300), edits):
            own[at] = f"other{at}"
        rows.append((i, " ".join(own), "en", "s3", 1, 3))
    rows.append((390, " ".join(long), "en", "s3", 1, 3))
    return rows


def test_against_plain_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    langs = plain_predict_all(rows)
    want = {i for i, (lang, score) in langs.items() if lang != "und" and score >= 0.05}
    assert set(kept["language"]) == want and not want & {300, 301, 302}
    assert all(r.lang == (langs[i][0] if dict((x[0], x[2]) for x in rows)[i] is None else dict((x[0], x[2]) for x in rows)[i]) for i, r in kept["language"].items())
    text = {x[0]: x[1] for x in rows}
    order = sorted(want)
    groups = plain_near([text[i] for i in order], order)
    want = set(groups.values())
    assert not want & {400, 401} and {402} <= want
    assert set(kept["near_duplicates"]) == want
    for i, r in kept["personal_data"].items():
        assert r.text == plain_redact(text[i]) and r.n_chars == len(r.text)
    assert set(kept["personal_data"]) == want and any("[EMAIL]" in r.text for r in kept["personal_data"].values())
    chances = plain_mix([(i, r.source, r.lang, r.text) for i, r in kept["personal_data"].items()])
    assert set(kept["mixture"]) == {i for i, p in chances.items() if chance(i) < p}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(r.text, add_special_tokens=False).ids, 0] for i, r in kept["mixture"].items()}
    got = Counter()
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.length <= 2048
        got[r.doc_id] += r.length
    assert got == {i: len(x) for i, x in ids.items()}
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert F is not None
