"""Sessions in a folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.logs import listing

PICTURES = ("jpg", "jpeg", "png")


def _flags(files: DataFrame, root: str, pictures: tuple[str, ...]) -> DataFrame:
    sc = files.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    below = F.substring("path", F.lit(len(whole) + 1), F.length("path"))
    rows = files.where(F.col("path").startswith(whole)).select(F.substring_index(below, "/", 1).alias("session_id"), below.alias("below"))
    rows = rows.select("session_id", F.substring("below", F.length("session_id") + 2, F.length("below")).alias("rest")).where("rest <> ''")
    picture = F.lower(F.substring_index("rest", ".", -1)).isin(*pictures)
    return rows.groupBy("session_id").agg(
        F.max(F.col("rest") == "aggregations.jsonl").alias("has_aggregations"),
        F.max(F.col("rest") == "data.jsonl").alias("has_data"),
        F.count(F.when(F.col("rest").startswith("screenshots/") & picture, 1)).alias("n_screenshots"),
        F.count(F.when(picture, 1)).alias("n_pictures"),
    )


def discover(spark: SparkSession, root: str, skip_existing: bool = False, pictures: tuple[str, ...] = PICTURES) -> DataFrame:
    """Sessions with an aggregation log and at least one screenshot: ``session_id``, ``n_screenshots``."""
    rows = _flags(listing(spark, root), root, pictures).where("has_aggregations and n_screenshots > 0")
    return (rows.where("not has_data") if skip_existing else rows).select("session_id", "n_screenshots")


def discover_pictures(spark: SparkSession, root: str, skip_existing: bool = False, pictures: tuple[str, ...] = PICTURES) -> DataFrame:
    """Sessions with pictures alone, in ``screenshots`` or in the session's folder itself; endings count in any case."""
    rows = _flags(listing(spark, root), root, pictures).where("n_pictures > 0")
    rows = rows.where("not has_data") if skip_existing else rows
    return rows.select("session_id", F.when(F.col("n_screenshots") > 0, F.col("n_screenshots")).otherwise(F.col("n_pictures")).alias("n_screenshots"))


def session_paths(folder: str) -> dict[str, str]:
    """Where the parts of a session lie."""
    names = {"screenshots": "screenshots", "aggregations": "aggregations.jsonl", "captions": "captions.jsonl", "matched": "data.jsonl", "chunk_captions": "captions", "chunk_aggregations": "aggregations", "chunks": "chunks"}
    return {k: f"{folder.rstrip('/')}/{v}" for k, v in names.items()}
