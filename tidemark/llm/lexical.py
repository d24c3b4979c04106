"""Ranked lexical search: items times terms, by terms times documents, as a blocked sparse product of integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import stored

#: Bytes to bytes: A-Z to a-z, digits, letters and all bytes of other characters to themselves, the rest to blanks.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A document's length counts nine parts in ten.
SLOPE = 90
LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(TO_TERMS).split()


def weight(documents: int, holding: int) -> int:
    """What a term counts for, in thousandths, that ``holding`` of all ``documents`` hold."""
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Term-document impacts: 64-bit integers from the counts of a term and of all terms of its document."""
    m = 100 - SLOPE + SLOPE * n * documents // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Rows:
    """A sparse matrix by rows: where each row begins, its columns and its values."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int):
        order = np.argsort(row, kind="stable")
        self.column, self.value = column[order], value[order]
        self.begin = np.searchsorted(row[order], np.arange(rows + 1))


def product_rows(left: Rows, right: Rows, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of ``left @ right``: each merges the rows of ``right`` that its non-zero columns name, into one dense row."""
    for i in range(len(left.begin) - 1):
        own = slice(left.begin[i], left.begin[i + 1])
        merged = np.zeros(columns, np.int64)
        for t, count in zip(left.column[own].tolist(), left.value[own].tolist(), strict=True):
            at = slice(right.begin[t], right.begin[t + 1])
            merged[right.column[at]] += count * right.value[at]  # a row of ``right`` names a column once
        yield i, merged


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, highest first, equal ones by ascending id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], rows: int = 256) -> DataFrame:
    """``id``, ``n`` (all terms of the document) and its counted terms of the vocabulary: arrays ``term`` and ``tf``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                sizes, ends, term, tf = [], [0], [], []
                for text in b.column(1).to_pylist():
                    found = terms(text)
                    counts = Counter(found)
                    for t in counts.keys() & known.keys():
                        term.append(known[t])
                        tf.append(counts[t])
                    sizes.append(len(found))
                    ends.append(len(term))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "term", "tf"])

    return docs.mapInArrow(run, "id long, n long, term array<int>, tf array<int>")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item, in two steps, so that no task takes in all blocks' rows of an item."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    some = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    few = found.withColumn("nth", some).where(F.col("nth") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("nth", "part")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, repeats: bool = False, item_terms: int = 1_000_000, block: int = 1 << 20, parts: int = 64) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_col``, ``rank`` (from 1), ``id_col``, ``score``.

    The scores are the product of two sparse matrices of integers, items by
    terms and terms by documents. Items are taken in blocks of about
    ``item_terms`` terms, of which one at a time is sent to the tasks; a task
    gathers its documents' postings in blocks of about ``block`` entries,
    multiplies each by the items' rows, merging the rows of the terms that an
    item has, and keeps the ``k`` best of each item from block to block. Only
    these leave the task. They are ranked in ``parts`` parts of an item, then whole.

    An item's terms count once each, or with ``repeats`` as often as they are
    in it. Rows of ``items`` with the same id are one item; null ids of items
    are one item too. Null and empty texts have no terms: such a document is
    never found and isn't counted, such an item finds nothing. Repeated
    documents are found each; equal scores go to the smaller id, null ids last.
    Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if counts := Counter(terms(text)):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(counts), pa.int64()), pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], names=["item", "term", "times"])

    wanted = asked.mapInArrow(split, "item long, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    wanted = stored(wanted, "items")
    blocks = max(1, -(-wanted.count() // item_terms))
    found = []
    for nth in range(blocks):
        # an item is in one block: its hash, null like any other
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == nth).toArrow()
        names, row = np.unique(own["item"].fill_null(LAST).to_numpy(), return_inverse=True)
        vocabulary: dict[bytes, int] = {}
        column = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own["term"].to_pylist()], np.int64)
        times = own["times"].to_numpy() if repeats else np.ones(len(column), np.int64)
        listed = stored(postings(slim, vocabulary), "postings")
        total = listed.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        holding = np.zeros(len(vocabulary), np.int64)
        held = listed.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
        holding[held["term"].to_numpy()] = held["count"].to_numpy()
        value = times * np.array([weight(total["documents"], int(holding[t])) for t in column], np.int64)
        left = spark.sparkContext.broadcast((names, Rows(row, column, value, len(names))))
        found.append(listed.mapInArrow(_multiply(left, len(vocabulary), total["documents"], total["length"], k, block), "item long, score long, doc long, nulls boolean"))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    doc = F.when(~F.col("nulls"), F.col("doc")).alias("doc")
    out = _ranked(both.select(F.nullif("item", F.lit(int(LAST))).alias("item"), "score", doc, F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")), k)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def _multiply(left, vocabulary: int, documents: int, length: int, k: int, block: int):
    """Arrow function: from postings to the best of each item in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = left.value
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def merge(part: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(part)
            lists = table["term"].combine_chunks()
            column = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy().astype(np.int64)
            tf, n = table["tf"].combine_chunks().flatten().to_numpy().astype(np.int64), table["n"].to_numpy()
            right = Rows(term, column, impacts(tf, n[column], documents, length), vocabulary)
            ids = table["id"].fill_null(LAST).to_numpy()
            for i, scores in product_rows(rows, right, table.num_rows):
                at = best(scores, ids, k)
                old = top.get(i, (np.empty(0, np.int64),) * 2)
                score, doc = np.concatenate([old[0], scores[at]]), np.concatenate([old[1], ids[at]])
                keep = best(score, doc, k)
                top[i] = score[keep], doc[keep]

        part, entries = [], 0
        for b in batches:
            part.append(b)
            entries += len(b.column(2).flatten()) + b.num_rows
            if entries >= block:
                merge(part)
                part, entries = [], 0
        if entries:
            merge(part)
        for i, (score, doc) in top.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), names[i])), pa.array(score), pa.array(doc), pa.array(doc == LAST)], names=["item", "score", "doc", "nulls"])

    return run

