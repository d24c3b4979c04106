"""Packing token sequences: exact-complement hashing over a length histogram, then best fit."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.util import fresh, sliced, stored, strings

#: How byte-level vocabularies write their bytes: printable Latin-1 as itself, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


#: So many blanks in a row are more than the faster library's pattern can go back over.
BLANKS = re.compile(r"\s{100000}")


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a ``tokenizer.json``, as its own library gives them without added special tokens.

    A special token that stands in a text gets its own id. A plain byte-level
    BPE is run by the faster of two libraries that give the same ids, but for
    texts with very long runs of blanks; its merges join in the order of their
    ids, which is what ranks mean. Any other file is run by its own library.
    """
    slow = lambda text: np.array(_own(path).encode(text, add_special_tokens=False).ids, np.int32)
    if (fast := _byte_level(path)) is None:
        return slow
    return lambda text: slow(text) if len(text) >= 100_000 and BLANKS.search(text) else fast.encode_to_numpy(text, allowed_special="all").astype(np.int32)


@cache
def _own(path: str) -> Tokenizer:
    """The named library's tokenizer, which takes much memory: made where a text asks for it."""
    return Tokenizer.from_file(path)


def _byte_level(path: str) -> tiktoken.Encoding | None:
    """The vocabulary for the faster library, if it is a plain byte-level BPE whose merges follow its ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added, split = spec["model"]["vocab"], spec["added_tokens"], spec["pre_tokenizer"] or {}
    special = {t["content"]: t["id"] for t in added}
    plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer") or not plain:
        return None
    others = iter(range(256, 512))
    to_byte = {chr(b if b in _PLAIN else next(others)): b for b in range(256)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if joined != sorted(joined):
        return None
    words = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte-level", pat_str=words, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``max_tokens``.

    Columns: ``id_col``, ``piece`` (from 0), ``start`` (the document's tokens
    before it), ``length``, ``ids``, and ``part`` and ``nth``: the task that
    made the piece, and how many pieces of that length it had made before. A
    text ends with ``end_id``; a null or empty one has that alone. All pieces
    but the first have ``max_tokens``.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("part", T.IntegerType()), ("nth", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        for b in sliced(batches):
            row, piece, start, length, nth, values = [], [], [], [], [], []
            for i, text in enumerate(strings(b.column(1))):
                ids = np.append(encode(text), np.int32(end_id))
                values.append(ids)
                at = 0
                for k in range(-(-len(ids) // max_tokens)):
                    n = max_tokens if k else (len(ids) - 1) % max_tokens + 1
                    row.append(i), piece.append(k), start.append(at), length.append(n), nth.append(made[n])
                    made[n] += 1
                    at += n
            if row:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), lists, pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Complements:
    """Index from a sum to the single length, the pairs and the triples that make it, under counts that only fall.

    A sum's pairs and triples are listed when it is first looked up, from the
    lengths then left. As counts only fall, an entry whose lengths have run out
    is dropped for good, so the lists are gone through once altogether.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _pair(self, total: int, have: np.ndarray) -> tuple[int, ...]:
        """Two lengths of sum ``total``, the smaller as small as can be."""
        if total not in self.pairs:
            low = np.arange(1, total // 2 + 1)
            self.pairs[total] = low[(self.left[low] > 0) & (self.left[total - low] > 0)][::-1].tolist()
        lows = self.pairs[total]
        while lows and not (self.left[lows[-1]] and self.left[total - lows[-1]]):
            lows.pop()
        for low in reversed(lows):
            if have[low] and have[total - low] and (2 * low != total or have[low] > 1):
                return total - low, low
        return ()

    def exact(self, gap: int, have: np.ndarray) -> tuple[int, ...]:
        """One to three lengths of sum ``gap`` that are there in ``have``, which is what is left but for those just chosen."""
        if have[gap] > 0:
            return (gap,)
        if two := self._pair(gap, have):
            return two
        if gap not in self.triples:
            self.triples[gap] = np.flatnonzero(self.left[:gap]).tolist()
        longest = self.triples[gap]
        while longest and not (self.left[longest[-1]] and self._pair(gap - longest[-1], self.left)):
            longest.pop()
        for a in reversed(longest):
            if have[a]:
                have[a] -= 1
                two = self._pair(gap - a, have)
                have[a] += 1
                if two:
                    return a, *two
        return ()


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How to pack so many pieces of each length: blocks ``(length, first, pieces, each, sequence, offset)``.

    Of a length's pieces, counted from 0, those from ``first`` on go ``each`` to
    a sequence, from ``sequence`` and ``offset`` on. The longest length left
    opens a sequence; its gap is looked up among the single lengths, then the
    sums of two and of three that are still available. Where none fits exactly,
    the longest piece that fits goes in, and the lookup is repeated for what
    is left. A combination is used as often as the counts allow at once, so
    each round uses up a length: the work depends on ``capacity`` and not on
    the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used, blocks, sequence, index = np.zeros(capacity + 1, np.int64), [], 0, Complements(left)
    while len(open_ := np.flatnonzero(left)):
        have, chosen = left.copy(), [int(open_[-1])]
        have[chosen[0]] -= 1
        gap = capacity - chosen[0]
        while gap > 0 and not (fill := index.exact(gap, have)):
            fits = np.flatnonzero(have[: gap + 1])
            if not len(fits):
                break
            chosen.append(int(fits[-1]))
            have[chosen[-1]] -= 1
            gap -= chosen[-1]
        else:
            chosen += fill if gap > 0 else ()
        each = Counter(chosen)
        times, offset = min(int(left[n]) // k for n, k in each.items()), 0
        for n, k in each.items():
            blocks.append((n, int(used[n]), times * k, k, sequence, offset))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
        sequence += times
    return sorted(blocks)


def place(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table with ``length``, ``part`` and ``nth``; these two go.

    Only the histogram of lengths, at most ``max_tokens`` rows, comes to the
    driver, and only the plan made from it goes out. Pieces get their number
    within their length from sums over the tasks' counts, so no task ever holds
    the pieces of one length together.
    """
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = packing_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_tokens)
    sent = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        blocks = sent.value
        size, at = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(blocks[:, 0] << 44 | blocks[:, 1], size << 44 | at, side="right") - 1
        i, each = at - blocks[k, 1], blocks[k, 3]
        return pd.DataFrame({"sequence_id": blocks[k, 4] + i // each, "offset": blocks[k, 5] + i % each * size})

    joined = pieces.join(base, ["part", "length"]).withColumn("placed", where("length", F.col("base") + F.col("nth")))
    return joined.select(*(c for c in pieces.columns if c not in ("part", "nth")), "placed.sequence_id", "placed.offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``max_tokens`` tokens.

    One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids``,
    ``sequence_id`` and ``offset``; a sequence's pieces are gapless from offset
    0. ``derive`` may replace ``ids`` by what is wanted of it before pieces are
    stored. Null texts count as empty (one ``end_id``); null or repeated ids
    are rows like any other; other columns are ignored; an empty table gives an
    empty result.
    """
    pieces = token_pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id)
    return place(stored(derive(pieces) if derive else pieces, "pieces"), max_tokens)


def with_crc32(pieces: DataFrame, ids_col: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace a list of ids by the unsigned CRC-32 of its little-endian 32-bit ids."""
    at = pieces.columns.index(ids_col)
    assert fresh(pieces, name) == name
    schema = T.StructType([T.StructField(name, T.LongType()) if f.name == ids_col else f for f in pieces.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if i == at else c for i, c in enumerate(b.columns)], names=schema.names)

    return pieces.mapInArrow(run, schema)
