"""Shared helpers: tables in the cluster's shared folder, and whole-row identities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions whose ``spark.checkpoint.dir`` is unset (tests), by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master, where that is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, lets later readers prune columns, and survives the loss
    of executors. An empty ``df`` gives an empty table of the same columns. The
    table goes when the application ends, or before that by ``discard`` or at the
    end of a ``passing`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for block in _open:
        block.append(out)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Arrow batches of few rows while the block runs, so that tasks hold little at a time; then the session's own setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read any more."""
    for t in tables:
        fs, at = _place(t.sparkSession, t._stored_at)
        fs.delete(at, True)


#: Lists of the tables that open ``passing`` blocks have seen.
_open: list[list[DataFrame]] = []


@contextmanager
def passing():
    """Delete, at the end, all tables that ``stored`` made inside the block; one that has to stay is removed from the given list."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        discard(*made)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most; Spark bounds their bytes (``spark.sql.execution.arrow.maxBytesPerBatch``)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """Texts of a batch; null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def unit_hash(col):
    """A number in [0, 1) from the md5 of a column's text: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)
