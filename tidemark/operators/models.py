"""Captions by a model: a pluggable client, chunk by chunk, with resumption."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Client(ABC):
    """A model that answers a prompt about a file."""

    @abstractmethod
    def upload(self, path: str, session_id: str | None = None) -> object: ...

    @abstractmethod
    def generate(self, prompt: str, file: object = None, schema: dict | None = None) -> str: ...


class FixedClient(Client):
    """A stand-in without a network: one caption of the prompt's length. Fails where a prompt says so."""

    def upload(self, path: str, session_id: str | None = None) -> object:
        return path

    def generate(self, prompt: str, file: object = None, schema: dict | None = None) -> str:
        if "FAIL" in prompt:
            raise RuntimeError("the model gave no answer")
        return json.dumps([{"start": "00:00", "end": "00:01", "caption": f"{len(prompt)} characters"}])


class ListingClient(Client):
    """A stand-in for a model that goes through the numbered lines of a prompt: each gets a caption and a task, even numbers are relevant."""

    def upload(self, path: str, session_id: str | None = None) -> object:
        return path

    def generate(self, prompt: str, file: object = None, schema: dict | None = None) -> str:
        ids = [int(n) for n in re.findall(r"(?m)^(?:\[ID: |ID )(\d+)", prompt)]
        entries = [{"id": n, "clean_caption": f"event {n}", "event_id": n, "task_ids": ["odd" if n % 2 else "even", *(["all"] if n % 3 == 0 else [])]} for n in ids]
        return json.dumps({"entries": entries, "caption": f"{len(ids)} steps", "category": "Data Processing", "relevant_event_ids": [n for n in ids if n % 2 == 0]})


CLIENTS: dict[str, Callable[..., Client]] = {"fixed": FixedClient, "listing": ListingClient}


def client(kind: str, **options) -> Client:
    """A client of a registered kind; an unknown kind is an error."""
    if kind not in CLIENTS:
        raise ValueError(f"no client of kind {kind!r}")
    return CLIENTS[kind](**options)


def pending(chunks: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Chunks without a result yet."""
    return chunks.join(done, by, "left_anti")


def answers(chunks: DataFrame, make: Callable[[], Client], prompt: str = "prompt", path: str | None = None, parallel: int | None = None) -> DataFrame:
    """``chunks`` with ``answer`` and ``error``: one call for each row, a client for each task; a failed call doesn't stop the rest.

    ``parallel`` bounds how many calls are made at a time.
    """
    rows = chunks.repartition(parallel) if parallel else chunks
    schema = T.StructType([*chunks.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            said, failed = [], []
            for i in range(len(b)):
                try:
                    file = model.upload(b[path].iloc[i]) if path else None
                    said.append(model.generate(b[prompt].iloc[i], file)), failed.append(None)
                except Exception as e:  # noqa: BLE001  a row's failure is its result
                    said.append(None), failed.append(str(e) or type(e).__name__)
            yield b.assign(answer=said, error=failed)

    return rows.mapInPandas(call, schema)


def resumed(done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Earlier results and new ones without an error."""
    return done.unionByName(fresh.where(F.col("error").isNull()), allowMissingColumns=True)


def entries(rows: DataFrame, answer: str, schema: str, keep: list[str]) -> DataFrame:
    """The records in answers of ``{"entries": [...]}``: ``keep`` and the fields of ``schema``; what doesn't parse has none."""
    parsed = F.from_json(answer, f"entries array<struct<{schema}>>")
    return rows.select(*keep, F.explode(parsed["entries"]).alias("e")).select(*keep, "e.*")


def clean_captions(transcripts: DataFrame, make: Callable[[], Client], by: list[str], instruction: str = "") -> DataFrame:
    """Captions that a model has freed of names: ``by``, ``event_no``, ``caption``; to be written over the old ones."""
    asked = transcripts.withColumn("prompt", F.concat(F.lit(instruction), F.col("transcript")))
    found = entries(answers(asked, make), "answer", "id:int,clean_caption:string", by)
    return found.select(*by, F.col("id").alias("event_no"), F.col("clean_caption").alias("caption"))


def segment_tasks(transcripts: DataFrame, make: Callable[[], Client], by: list[str], instruction: str = "") -> DataFrame:
    """Tasks of each event, by a model: ``by``, ``event_no``, ``task_ids``."""
    asked = transcripts.withColumn("prompt", F.concat(F.lit(instruction), F.col("transcript")))
    found = entries(answers(asked, make), "answer", "event_id:int,task_ids:array<string>", by)
    return found.select(*by, F.col("event_id").alias("event_no"), "task_ids")


def register(kind: str, make: Callable[..., Client]) -> None:
    """Make a kind of client known by name."""
    CLIENTS[kind] = make


def describe_tasks(task_rows: DataFrame, make: Callable[[], Client], by: list[str], number: str = "event_no", caption: str = "caption", instruction: str = "") -> DataFrame:
    """A model's description of each task, and which of its events matter: ``by``, ``task_id``, ``task_caption``, ``task_category``, ``number``.

    One call for each task with its captions in order; the events it doesn't name
    are left out, and tasks without a usable answer too.
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(caption).alias("c"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("ID "), x["n"], F.lit(": "), F.coalesce(x["c"], F.lit("")))), "\n")
    asked = task_rows.groupBy(*by, "task_id").agg(F.collect_set(number).alias("_there"), F.concat(F.lit(instruction), text).alias("prompt"))
    said = F.from_json("answer", "caption string, category string, relevant_event_ids array<int>")
    told = answers(asked, make).select(*by, "task_id", "_there", said.alias("a")).where("a.relevant_event_ids is not null")
    named = F.array_intersect("_there", F.col("a.relevant_event_ids").cast("array<int>"))
    return told.select(*by, "task_id", F.col("a.caption").alias("task_caption"), F.col("a.category").alias("task_category"), F.explode(named).alias(number))
