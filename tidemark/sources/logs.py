"""Readers of recorded logs."""

from __future__ import annotations

import ast
import json
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import coarse, unsigned_to_signed
from tidemark.functions.timefmt import listing_time
from tidemark.schemas import AGGREGATION, CAPTION, EVENT, MATCHED


def _python_to_json(line: str | None) -> str | None:
    """A Python literal of a dict as JSON; null for anything else."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(line or "")
        return json.dumps(value) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def python_literal_json(lines: pd.Series) -> pd.Series:
    return lines.map(_python_to_json)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of ``schema`` from lines that are JSON objects or Python literals of dicts; others, and blank ones, are left out.

    Lines of JSON stay in the JVM; the others alone pass through Python, in
    Arrow batches. A time that isn't of the schema's type becomes null.
    """
    text = F.trim(F.col(column))
    rows = lines.where(text != "").select("*", text.alias("_text")).withColumn("_json", F.try_parse_json("_text").isNotNull())
    js = rows.where("_json").drop("_json")
    py = rows.where("not _json").drop("_json").withColumn("_text", python_literal_json("_text"))
    keep = [c for c in lines.columns if c != column]
    parsed = js.unionByName(py).where(F.substring("_text", 1, 1) == "{")
    return parsed.select(*keep, F.from_json("_text", schema).alias("_row")).where("_row is not null").select(*keep, "_row.*")


def bad_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither blank, JSON nor a Python literal of a dict."""
    text = F.trim(F.col(column))
    rest = lines.where((text != "") & F.try_parse_json(text).isNull())
    return rest.where(python_literal_json(text).isNull())


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log, with ``coarse_type``."""
    return read_records(spark, path, EVENT).withColumn("coarse_type", coarse(F.col("event_type")))


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a growing folder of log files, each file read once it has landed; the folder may be empty at first."""
    return spark.readStream.format("text").load(folder)


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON events of a growing folder of log files."""
    return spark.readStream.schema(EVENT).json(folder)


def read_aggregations(spark: SparkSession, path: str) -> DataFrame:
    """The aggregation log, ``timestamp`` being the frame's where a line has that key."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    rows = rows.select(F.from_json("value", AGGREGATION).alias("r"), F.json_object_keys("value").alias("keys"))
    has = F.array_contains("keys", "screenshot_timestamp")
    return rows.select("r.*", "keys", has.alias("_has")).withColumn("timestamp", F.when(F.col("_has"), F.col("screenshot_timestamp")).otherwise(F.col("timestamp"))).drop("keys", "_has")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTION).json(path)


def read_matched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCHED).json(path)


def rows_with_pictures(matched: DataFrame) -> DataFrame:
    """Matched rows that have a picture; without any that is an error."""
    rows = matched.where(F.coalesce("img", F.lit("")) != "")
    if not rows.limit(1).count():
        raise ValueError("no row has a picture")
    return rows


#: A piece of a hash cache up to a closing brace: an entry, with what opens the document before it; or nothing; or the opening alone.
CACHE_ENTRY = r'^\s*(?:\{\s*"entries"\s*:\s*\{|,)?\s*"((?:[^"\\]++|\\.)*+)"\s*:\s*\{\s*"hash_int"\s*:\s*([0-9]+)\s*$'
CACHE_REST = r'^\s*(?:\{\s*"entries"\s*:\s*\{\s*)?$'


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """The hash cache as ``key``, ``hash``: unsigned hashes as longs of the same bits. ``path`` is a document or a folder of them.

    A document is read in pieces that end at its closing braces, so a large one
    is split over tasks and none holds it whole. Where a piece isn't just an
    entry (a brace in a key, other fields), the documents are parsed whole.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    entry = F.regexp_extract("value", CACHE_ENTRY, 2)
    odd = pieces.where(~F.col("value").rlike(CACHE_ENTRY) & ~F.col("value").rlike(CACHE_REST))
    if not odd.limit(1).count():
        key = F.from_json(F.concat(F.lit('["'), F.regexp_extract("value", CACHE_ENTRY, 1), F.lit('"]')), "array<string>")[0]
        return pieces.where(entry != "").select(key.alias("key"), unsigned_to_signed(entry.cast("decimal(20,0)")).alias("hash"))
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "entries map<string, struct<hash_int: decimal(20,0)>>")["entries"]
    return text.select(F.explode(entries).alias("key", "entry")).select("key", unsigned_to_signed(F.col("entry.hash_int")).alias("hash"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: ``path``, ``modified`` (seconds); their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", (F.unix_micros("modificationTime") / 1e6).alias("modified"))


def list_screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures (jpg, then png) with a time in their name: ``path``, ``ts``, ``position`` in time order."""
    from pyspark.sql import Window

    rows = listing(spark, folder).where(F.col("path").rlike(r"\.(?:jpg|png)$"))
    rows = rows.select("path", listing_time(F.substring_index("path", "/", -1)).alias("ts")).where("ts is not null")
    rows = rows.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    order = Window.partitionBy("folder").orderBy("ts", F.col("path").endswith(".png"), "path")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("folder")


def resolve_pictures(rows: DataFrame, files: DataFrame, img: str, session_dir: Column) -> DataFrame:
    """``rows`` with ``resolved``: the path itself if that file is there, else the file of that name in the session's screenshots."""
    there = files.select(F.col("path").alias("_there"))
    beside = files.select(F.col("path").alias("_beside"))
    named = rows.withColumn("_second", F.concat(session_dir, F.lit("/screenshots/"), F.substring_index(img, "/", -1)))
    found = named.join(there, F.col(img) == F.col("_there"), "left").join(beside, F.col("_second") == F.col("_beside"), "left")
    return found.withColumn("resolved", F.coalesce("_there", "_beside")).drop("_there", "_beside", "_second")
