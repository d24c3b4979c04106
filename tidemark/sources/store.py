"""A table of results by key, of which any key can be written anew: versions are added, the last one of a key counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE, DELTA = "base", "delta"
VERSION, BUCKET, GONE = "_version", "_bucket", "_gone"


class ChunkStore:
    """Rows of the same ``keys`` (a session's chunk, say) are replaced together.

    Each ``upsert`` adds one folder, ``delta-N``, with a file or so for each of
    ``buckets`` hash buckets that it touches: how many files there are follows
    from upserts and buckets, not from keys. A reader takes the rows of each key's
    highest version. A folder counts once Spark has committed it (``_SUCCESS``),
    so a job that dies leaves nothing behind that is read, and may run again.
    ``compact`` writes what counts as ``base-N``; older folders aren't read any more.

    One writer at a time; readers may come at any time. Keys may hold nulls.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[tuple[int, str]]:
        """Committed folders that still count: the last base and the deltas after it, in order."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [m for s in fs.listStatus(at) if (m := re.fullmatch(r"(base|delta)-(\d+)", s.getPath().getName()))]
        done = sorted((int(m[2]), m[1]) for m in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m[0]}/_SUCCESS")))
        last = max((v for v, kind in done if kind == BASE), default=0)
        return [(v, kind) for v, kind in done if v >= last]

    def _write(self, rows: DataFrame, kind: str) -> int:
        found = self.versions()
        version = max((v for v, _ in found), default=0) + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        out = rows.withColumn(VERSION, F.lit(version).cast("bigint")) if kind == DELTA else rows
        out.withColumn(BUCKET, bucket).repartition(self.buckets, BUCKET).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}-{version:09d}")
        return version

    def upsert(self, rows: DataFrame, emptied: DataFrame | None = None) -> int:
        """Replace the chunks whose keys are in ``rows``; those in ``emptied`` (columns ``keys``) are left without rows. Gives the new version."""
        out = rows.withColumn(GONE, F.lit(False))
        if emptied is not None:
            out = out.unionByName(emptied.select(*self.keys).distinct().withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        return self._write(out, DELTA)

    def _current(self) -> DataFrame | None:
        found = self.versions()
        if not found:
            return None
        # each folder has its own columns; a later one may have more
        parts = [self.spark.read.parquet(f"{self.path}/{kind}-{v:09d}") for v, kind in found]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        if len(parts) == 1:
            return rows
        # of a key one number for each task is exchanged, then the rows that count are picked; large chunks are split by adaptive execution
        key = F.struct(*self.keys)
        newest = rows.groupBy(key.alias("_key")).agg(F.max(VERSION).alias("_newest"))
        return rows.withColumn("_key", key).join(newest, "_key").where(F.col(VERSION) == F.col("_newest")).drop("_key", "_newest")

    def read(self) -> DataFrame:
        """The rows that count. A store that was never written to has no columns to give: ``FileNotFoundError``."""
        rows = self._current()
        if rows is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        return rows.where(~F.col(GONE)).drop(VERSION, BUCKET, GONE)

    def keys_done(self) -> DataFrame | None:
        """Keys that have a result, empty ones too; None before the first."""
        rows = self._current()
        return None if rows is None else rows.select(*self.keys).distinct()

    def compact(self, keep_old: bool = False) -> int:
        """Write what counts as a new base; older folders are deleted unless ``keep_old``."""
        rows = self._current()
        if rows is None:
            return 0
        old = self.versions()
        version = self._write(rows.drop(BUCKET), BASE)
        if not keep_old:
            fs, _ = self._fs()
            for v, kind in old:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{v:09d}"), True)
        return version
