"""The tail of one growing log as a stream of lines."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TailReader(SimpleDataSourceStreamReader):
    """Whole lines from a byte offset on; ``most`` bytes at a time, or one line if that is longer.

    A file that is shorter than the offset has been cut or replaced and is read
    from its start. The last line waits until its line break is there.
    """

    def __init__(self, path: str, most: int, from_start: bool = True):
        self.path, self.most, self.from_start = path, most, from_start

    def initialOffset(self) -> dict:
        return {"at": 0 if self.from_start or not os.path.exists(self.path) else os.path.getsize(self.path)}

    def _lines(self, at: int, end: int | None = None) -> tuple[list[tuple], int]:
        try:
            size = os.path.getsize(self.path)
        except FileNotFoundError:
            return [], at
        if size < at:
            at = 0
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(self.most if end is None else max(0, end - at))
            if end is None and b"\n" not in data:
                data += f.readline()
        whole = data[: data.rfind(b"\n") + 1]
        return [(line.decode("utf-8", "replace").rstrip("\r"),) for line in whole.split(b"\n")[:-1]], at + len(whole)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._lines(start["at"])
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"] if start["at"] <= end["at"] else 0
        return iter(self._lines(at, end["at"])[0])


class Tail(DataSource):
    """``spark.readStream.format("tail").option("path", ...)``: column ``value``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("maxBytes", 1 << 20)), self.options.get("fromStart", "true").lower() == "true")


def tail_lines(spark: SparkSession, path: str, max_bytes: int = 1 << 20, from_start: bool = True) -> DataFrame:
    """Lines of one local log while it grows, each once, from its start or only those to come; a log that was cut is read anew. The file may come later."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", path).option("maxBytes", max_bytes).option("fromStart", str(from_start).lower()).load()
