"""Writers of events, aggregations, captions, chunks and datasets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import frame_name


def append_json(df: DataFrame, path: str) -> None:
    """Add records (events, aggregations, frame metadata) to a JSON log."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace a JSON log (captions, matched rows, sanitized records, tasks)."""
    df.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunk results as one folder of JSON for each session and chunk, for readers that look them up by path; only the chunks at hand are replaced.

    There are as many files as chunks. ``store.ChunkStore`` keeps results of any number of chunks in few files.
    """
    df.repartition("session_id", "chunk_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "chunk_index").json(path)


def write_hashes(hashes: DataFrame, path: str, key: str = "key", value: str = "hash_int") -> None:
    """A hash cache (``value``: unsigned hashes) as a folder of JSON documents, one for each task, entry by entry: no task holds its document."""
    entry = F.concat(F.to_json(F.array(F.col(key).cast("string"))), F.lit(": "), F.to_json(F.struct(F.col(value).cast("decimal(20,0)").alias("hash_int"))))
    lines = hashes.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(entry.alias("value"))

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comma = ""
        yield pd.DataFrame({"value": ['{"entries": {']})
        for b in batches:
            out = []
            for text in b["value"]:  # ["key"]: {...}
                at = text.rindex("]: {")
                out.append(comma + text[1:at] + text[at + 1 :])
                comma = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["}}"]})

    lines.mapInPandas(document, "value string").write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """A dataset by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def chosen_frames(frames: DataFrame, forced: Column, reason: Column, ts: str = "frame_ts", buffer_all: bool = False) -> DataFrame:
    """Metadata of the frames whose pictures are kept: ``forced`` ones, or all with ``buffer_all``; ``path`` has time and reason."""
    kept = frames if buffer_all else frames.where(F.coalesce(forced, F.lit(False)))
    return kept.withColumn("path", frame_name(F.col(ts) / 1e6, reason))


def stream_to_json(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a JSON log; with ``once``, what is there now, and then end."""
    writer = df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_to(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Call ``each`` with every batch of a stream; at every ``interval``, or with what is there now, and then end."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_to_console(df: DataFrame, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("console").outputMode("append").option("checkpointLocation", checkpoint).start()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for tables on their way: below ``spark.checkpoint.dir``, or on a local master, where that is unset, in a temporary folder. It goes when the application ends."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to a new ``scratch`` table and read back: it is computed once, and a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
