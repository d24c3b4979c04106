"""Tasks made of captioned events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import transcript_line
from tidemark.functions.timefmt import clock


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "event_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def transcripts(rows: DataFrame, by: list[str], number: str, seconds: str, caption: str) -> DataFrame:
    """One transcript for each ``by``: a line for every row, by number."""
    line = transcript_line(F.col(number).cast("string"), clock(F.col(seconds)), F.col(caption))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("transcript"))


def grouped(segmentation: DataFrame, rows: DataFrame, by: list[str], number: str = "event_no", tasks: str = "task_ids") -> DataFrame:
    """Rows of each task: an event may be in several; numbers that no row has are skipped. Adds ``task_id``."""
    pairs = segmentation.select(*by, number, F.explode(tasks).alias("task_id"))
    return pairs.join(rows, [*by, number])


def only_chosen(grouped_rows: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a task that were chosen for it."""
    return grouped_rows.join(chosen, by, "left_semi")


def noise(rows: DataFrame, used: DataFrame, by: list[str]) -> DataFrame:
    """Rows in no task."""
    return rows.join(used, by, "left_anti")


def overwritten(rows: DataFrame, changes: DataFrame, by: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``changes`` has a row of the same ``by``."""
    new = changes.select(*by, F.col(column).alias("_new"))
    return rows.join(new, by, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def noise_totals(rows: DataFrame, used: DataFrame, by: list[str], kind: str) -> DataFrame:
    """One row for each kind: its rows in no task, and all its rows."""
    in_task = used.select(*by).distinct().withColumn("_used", F.lit(1))
    marked = rows.join(in_task, by, "left")
    return marked.groupBy(kind).agg(F.count(F.when(F.col("_used").isNull(), 1)).alias("n_noise"), F.count("*").alias("n"))
