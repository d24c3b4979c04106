"""Shared tables, batches and clashing names."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.llm import gif, langid, licenses, mixing, simhash, util


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        util.shared_dir(spark)


def test_tables_pass_with_their_block(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    with util.passing() as made:
        gone, stays = util.stored(spark.range(3), "gone"), util.stored(spark.range(4), "stays")
        assert made.pop() is stays
    assert stays.count() == 4 and spark.conf.get(key) == own
    there = [os.path.isdir(t._stored_at.removeprefix("file://")) for t in (gone, stays)]
    assert there == [False, True]
    util.discard(stays)


@pytest.mark.parametrize("name", ["media", "frames", "payload", "licenses", "lang_pred", "score", "fp", "probability", "sampled"])
def test_columns_of_the_same_name_are_replaced(spark, name):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "en", "a", 5, "own")], f"doc_id long, text string, lang string, source string, tokens long, {name} string")
    profiles = langid.fit(docs.select("text", "lang"))
    made = {
        "media": lambda: gif.with_gif(docs),
        "frames": lambda: gif.with_frames(gif.with_gif(docs)),
        "payload": lambda: gif.with_frames(gif.with_gif(docs)),
        "licenses": lambda: licenses.with_licenses(docs),
        "lang_pred": lambda: langid.with_language(docs, profiles),
        "score": lambda: langid.with_language(docs, profiles),
        "fp": lambda: simhash.with_fingerprint(docs),
        "probability": lambda: mixing.mix(docs, {"source": 0.5}, 0.5),
        "sampled": lambda: mixing.mix(docs, {"source": 0.5}, 0.5),
    }[name]()
    assert made.columns.count(name) == 1
    (row,) = made.select("doc_id", F.col(name).alias("x")).collect()
    assert row.doc_id == 1 and row.x != "own"
