"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import fresh, sliced, strings

UNKNOWN = "und"
#: Stands for any run of characters that aren't letters.
EDGE = 1
LONGEST = 3
WIDTH = 21  # bits of a code point in an n-gram's key


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else EDGE."""
    return np.array([c if chr(c).isalpha() else EDGE for c in range(0x110000)], np.int32)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct n-grams (1 to 3 letters, lower case, words edged) of a text, ascending, and their counts.

    A key holds the code points of an n-gram, the last one lowest, so shorter
    n-grams come first. Without letters there are none.
    """
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    if not len(codes) or codes.max() == EDGE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([[EDGE], codes, [EDGE]])
    codes = codes[(codes != EDGE) | np.concatenate([[True], codes[1:] != codes[:-1]])]
    alphabet = np.flatnonzero(np.bincount(codes)) if codes.max() < 1 << 16 else np.unique(codes)
    size = len(alphabet)
    c = np.searchsorted(alphabet, codes).astype(np.int32 if size < 1000 else np.int64)
    one = c[c > 0]  # EDGE is the smallest
    two = c[:-1] * size + c[1:] + size
    three = (c[:-2] * size + c[1:-1]) * size + c[2:] + size + size * size
    found = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    counts, small = np.diff(np.append(first, len(found))), found[first].astype(np.int64)
    wide = alphabet.astype(np.int64)
    is_two, is_three = (small >= size) & (small < size + size * size), small >= size + size * size
    keys = np.empty(len(small), np.int64)
    keys[~is_two & ~is_three] = wide[small[~is_two & ~is_three]]
    x = small[is_two] - size
    keys[is_two] = wide[x // size] << WIDTH | wide[x % size]
    x = small[is_three] - size - size * size
    keys[is_three] = (wide[x // (size * size)] << WIDTH | wide[x // size % size]) << WIDTH | wide[x % size]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The keys of the ``most`` highest counts, highest first; of equal counts the smaller key first."""
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Ranked n-grams of each language, looked up by one sorted table of all their keys."""

    def __init__(self, by_language: dict[str, np.ndarray], most: int):
        self.names, self.most = sorted(by_language), most
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *by_language.values()]))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, by_language[name]), j] = np.arange(len(by_language[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, and one minus its distance relative to the largest one possible."""
        keys, counts = ngrams(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        mine = ranked(keys, counts, self.most)
        at = np.searchsorted(self.keys, mine)
        at[np.append(self.keys, -1)[at] != mine] = len(self.keys)
        theirs = self.ranks[at]
        away = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.most * len(mine)))


def held_out(id_col: str = "doc_id"):
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 400, sample_rows: int = 20_000) -> Profiles:
    """Learn a profile of the ``most`` frequent n-grams of each language.

    Rows with a null language or text are left out. From about ``sample_rows``
    rows, chosen by a hash of the text in proportion to their number, n-grams
    are counted in the tasks and summed by a shuffle; then each task keeps its
    ``most`` highest counts of a language (after the shuffle an n-gram's count
    is whole), and those few come to the driver.
    """
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    share = min(1.0, sample_rows / max(1, labelled.where(F.col(lang_col).isNotNull()).count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, langs, found = strings(b.column(0)), b.column(1).to_pylist(), {}
            for text, lang in zip(texts, langs, strict=True):
                found.setdefault(lang, []).append(ngrams(text))
            for lang, grams in found.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([c for _, c in grams]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(sums)], names=["lang", "key", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        for b in batches:
            langs, keys, sums = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
            for lang in set(langs):
                own = langs == lang
                k, n = rows.get(lang, (np.empty(0, np.int64),) * 2)
                k, n = np.concatenate([k, keys[own]]), np.concatenate([n, sums[own]])
                top = np.lexsort((k, -n))[:most]
                rows[lang] = k[top], n[top]
        for lang, (k, n) in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "key", "n"])

    schema = "lang string, key long, n long"
    whole = known.mapInArrow(count, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top = whole.mapInArrow(best, schema).toPandas()
    profiles = {lang: ranked(g["key"].to_numpy(), g["n"].to_numpy(), most) for lang, g in top.groupby("lang")}
    return Profiles(profiles, most)


def with_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs``, the predicted language of the whole text and its score (0 to 1).

    A text that is null, or has no letter, gets ``und`` and score 0. Of
    languages at the same distance the first by name is predicted. Repeated rows
    stay repeated, columns of these names are replaced, an empty table stays empty.
    """
    spark = docs.sparkSession
    docs = docs.drop(lang_name, score_name)
    sent, at = spark.sparkContext.broadcast(profiles), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [sent.value.predict(t) for t in strings(b.column(at))]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, lang_name, score_name])

    schema = docs.select("*", F.lit("").cast("string").alias(lang_name), F.lit(0.0).alias(score_name)).schema
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 400, sample_rows: int = 20_000) -> DataFrame:
    """Learn from labelled documents outside the held-out fold; predict every document.

    One row per document: ``id_col``, ``held_out``, ``lang_pred``, ``score``.
    Null ids belong to the fold of the empty text. Repeated rows stay repeated;
    without labelled rows all are ``und``; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    profiles = fit(slim.where(~held_out("id")), "text", "lang", most, sample_rows)
    out = with_language(slim.select("id", held_out("id").alias("held_out"), "text"), profiles)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.05) -> DataFrame:
    """``docs`` without the documents in no language: those with no letter, or nowhere near any profile.

    A null language is filled in with the predicted one; all else stays.
    Without labelled rows to learn from, nothing is rejected.
    """
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    profiles = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    if not profiles.names:
        return docs
    kept = with_language(docs, profiles, text_col, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score))
    return kept.withColumn(lang_col, F.coalesce(lang_col, lang)).select(*docs.columns)
