"""Mixing sources to target weights: raking, then sampling by calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import fresh, stored, unit_hash

#: Cells raked on the driver; more are raked by Spark, with the same steps.
DRIVER_CELLS = 50_000
#: Cells broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 50_000
#: The value of a dimension where a document has none.
NONE = ""


def tokens(text: Column) -> Column:
    """The weight of a text: its number of words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from a text's form: ``table``, ``markup``, ``listing``, ``note`` (under 100 words), else ``prose``."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(r"[%*&$#]{3}"), "markup")
        .when(text.rlike(r"(?m)^\s*(?:[-*]|[0-9]+\.)\s"), "listing")
        .when(F.length(text) < 600, "note")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension: its observed token shares to a power below one, which lifts the small."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    total = own.agg(F.sum(F.pow("tokens", F.lit(power))).alias("total"))
    return own.join(F.broadcast(total)).select(dimension, (F.pow("tokens", F.lit(power)) / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 50, close: float = 1e-6) -> DataFrame:
    """Iterative proportional fitting of ``cells`` (a column for each dimension, ``tokens``) to target shares.

    ``targets`` has, for each dimension, its values and their ``share``; shares
    are scaled to the values that have tokens, a value without target has share
    0. Returns ``cells`` with ``weight``, the fitted share of all tokens. Each
    round scales the cells to each dimension in turn, until no margin is off by
    ``close`` or after ``rounds``. Up to ``DRIVER_CELLS`` cells, counted first,
    are fitted on the driver, more as DataFrames with a table for each round.
    """
    dims = list(targets)
    cells = cells.where("tokens > 0")
    wanted = {}
    for d in dims:
        there = cells.select(d).distinct().join(targets[d].select(d, "share"), d, "left").fillna(0.0, ["share"])
        total = there.agg(F.sum("share").alias("sum"))
        wanted[d] = there.join(F.broadcast(total)).select(d, (F.col("share") / F.col("sum")).alias("share"))
    if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        local = cells.orderBy(*dims).toPandas()
        weight = local["tokens"].to_numpy(float)
        weight = weight / max(weight.sum(), 1)
        shares = {d: local[d].map(wanted[d].toPandas().set_index(d)["share"]).to_numpy(float) for d in dims}
        codes = {d: pd.factorize(local[d])[0] for d in dims}
        for _ in range(rounds if len(local) else 0):
            off = 0.0
            for d in dims:
                margin = np.bincount(codes[d], weight)[codes[d]]
                off = max(off, float(np.abs(margin - shares[d]).max()))
                weight = weight * np.divide(shares[d], margin, out=np.zeros_like(margin), where=margin > 0)
            if off < close:
                break
        return cells.sparkSession.createDataFrame(local.assign(weight=weight), cells.schema.add("weight", "double"))
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted = stored(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    wanted = {d: stored(w, "targets") for d, w in wanted.items()}
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            margin = stored(fitted.groupBy(d).agg(F.sum("weight").alias("margin")).join(wanted[d], d), "margins")
            off = max(off, margin.agg(F.max(F.abs(F.col("margin") - F.col("share")))).first()[0])
            factor = F.when(F.col("margin") > 0, F.col("share") / F.col("margin")).otherwise(0.0)
            fitted = fitted.join(margin.select(d, factor.alias("factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).select(*cells.columns, "weight")
        fitted = stored(fitted, "cells")
        if off < close:
            break
    return fitted


def probabilities(fitted: DataFrame, keep: float) -> DataFrame:
    """``fitted`` with ``probability``, so that about ``keep`` of all tokens are expected to stay.

    In proportion to the weight of a cell over its tokens, up to 1; the common
    factor is found by bisection over sums of the cells.
    """
    ratio = F.col("weight") / F.col("tokens")
    total, weighted, low = fitted.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))), F.min(F.when(F.col("weight") > 0, ratio))).first()
    if not total or not weighted:
        return fitted.withColumn("probability", F.lit(0.0))
    goal, down, up = keep * total, 0.0, 1 / low
    if goal >= weighted:
        down = up
    steps = 24
    while down < up * (1 - 1e-9):  # two dozen factors at a time, in one pass over the cells
        tries = [down + (up - down) * i / steps for i in range(1, steps + 1)]
        sums = fitted.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * x)) for x in tries)).first()
        at = next((i for i, s in enumerate(sums) if s >= goal), steps - 1)
        down, up = (tries[at - 1] if at else down), tries[at]
    return fitted.withColumn("probability", F.least(F.lit(1.0), ratio * up))


def mix(docs: DataFrame, dimensions: dict[str, float | DataFrame], keep: float, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``docs`` with ``probability`` and ``sampled``.

    ``dimensions`` gives columns of ``docs`` and their targets: a table of the
    values (as text, in a column of that name) and their ``share``, or the power that tempers
    their token shares. Columns ``probability`` and ``sampled`` of ``docs`` are replaced; repeated rows
    stay or go together; an empty table stays empty. All documents are counted into cells, tasks first;
    cells are raked; every document stays with its cell's probability, decided
    by a hash of its id (of its other columns if that is null), so a document
    is decided alike wherever it runs. Null values of a dimension are a value
    of their own; documents without tokens have probability 0 unless all
    have none.
    """
    docs, dims = docs.drop("probability", "sampled"), list(dimensions)
    keys = {d: fresh(docs, f"{d}_key") for d in dims}
    values = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in dims}
    cells = stored(docs.groupBy(*(values[d].alias(keys[d]) for d in dims)).agg(F.coalesce(F.sum(tokens_col), F.lit(0)).cast("long").alias("tokens")), "cells")
    given = lambda d, t: t.select(F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(keys[d]), "share") if isinstance(t, DataFrame) else tempered(cells, keys[d], t)
    fitted = probabilities(rake(cells, {keys[d]: given(d, t) for d, t in dimensions.items()}), keep)
    chances = stored(fitted.select(*keys.values(), "probability"), "chances")
    small = F.broadcast(chances) if chances.count() <= BROADCAST_CELLS else chances
    marked = docs.select("*", *(values[d].alias(keys[d]) for d in dims)).join(small, list(keys.values()), "left").fillna(0.0, ["probability"])
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int", "double")]
    chance = unit_hash(F.coalesce(F.col(id_col).cast("string"), F.concat_ws("|", *rest)))
    return marked.withColumn("sampled", chance < F.col("probability")).drop(*keys.values())


def mix_documents(docs: DataFrame, keep: float = 0.8, source_power: float = 0.7, lang_power: float = 0.8, topic_power: float = 0.8) -> DataFrame:
    """Documents (``doc_id``, ``text``, ``lang``, ``source``) mixed by source, language and topic.

    Columns: ``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``,
    ``probability``, ``sampled``. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "source", "lang", topic(text).alias("topic"), tokens(text).alias("tokens"))
    slim = stored(slim, "weights")
    return mix(slim, {"source": source_power, "lang": lang_power, "topic": topic_power}, keep)


def keep_mixed(docs: DataFrame, keep: float = 0.8, source_power: float = 0.7, lang_power: float = 0.8, topic_power: float = 0.8) -> DataFrame:
    """The sampled documents, with their columns as they were."""
    names = {n: fresh(docs, n) for n in ("topic", "tokens")}
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("*", topic(text).alias(names["topic"]), tokens(text).alias(names["tokens"]))
    dims = {"source": source_power, "lang": lang_power, names["topic"]: topic_power}
    clash = {c: f"own_{c}" for c in docs.columns if c in ("probability", "sampled")}
    mixed = mix(whole.withColumnsRenamed(clash), dims, keep, "doc_id", names["tokens"]).where("sampled").drop("probability", "sampled")
    return mixed.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
