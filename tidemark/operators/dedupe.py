"""Frames that differ little from the one kept before them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import hash_key


def keep_changed(frames: DataFrame, by: list[str], order: list[str], hash_col: str, threshold: int = 1) -> DataFrame:
    """Frames whose hash differs in more than ``threshold`` bits from the last one kept.

    The first frame stays, and so does one without a hash, after which the next
    one stays too. Rows are folded in order, batch by batch; a task holds one
    hash only.
    """
    at = [frames.columns.index(c) for c in by]
    dealt = frames.withColumn("_absent", F.col(hash_col).isNull()).withColumn("_hash", F.coalesce(hash_col, F.lit(0)).cast("bigint"))
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            keep = []
            for row in b.itertuples(index=False, name=None):
                own, absent, bits = tuple(row[i] for i in at), row[-2], row[-1]
                if own != key:
                    key, last = own, None
                good = absent or last is None or ((last ^ bits) & ((1 << 64) - 1)).bit_count() > threshold
                if good:
                    last = None if absent else bits
                keep.append(bool(good))
            yield b[keep].drop(columns=["_absent", "_hash"])

    return dealt.mapInPandas(fold, frames.schema)


def with_hashes(rows: DataFrame, hashes: DataFrame, path: str, name: str = "hash") -> DataFrame:
    """``rows`` with the hash that the cache has for their path, by its last three parts; null where it has none."""
    known = hashes.select(F.col("key").alias("_key"), F.col("hash").alias(name))
    return rows.join(known, hash_key(F.col(path)) == F.col("_key"), "left").drop("_key")
