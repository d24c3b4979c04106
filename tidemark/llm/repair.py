"""Repair of conversations: a composition of finite-state machines, and its cheapest path with the least string of edits.

The turns of a conversation are an acceptor with one state between any two
turns, the edits a transducer from turns to roles, the order that roles may
have another acceptor. States of the composition are pairs of a place and a
state of the grammar; their arcs are made when they are first asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: No path.
NEVER = 1 << 60
#: Rows of a block: what a task takes in at once; a conversation may cross any number of them.
BLOCK_BITS = 12
BLANKS = " \t\n\x0b\f\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: ``arcs`` from (state, initial) to state; states are numbered from 0."""

    arcs: dict[tuple[int, str], int]
    accepting: frozenset[int]
    start: int = 0

    @cached_property
    def states(self) -> int:
        return 1 + max([self.start, *self.accepting, *(q for q, _ in self.arcs), *self.arcs.values()])


#: ``(s?(ua)+)?``: nothing, or a system turn or none, then user and assistant by turns.
DIALOGUE = Grammar({(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, frozenset({0, 3}))
#: Pairs of initials that may follow each other.
LEGAL = frozenset({"su", "ua", "au"})


@dataclass(frozen=True)
class Edits:
    """What edits cost; ``roles`` are those that a turn may be given, by initial."""

    roles: tuple[tuple[str, str], ...] = (("u", "user"), ("a", "assistant"))
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    #: For a truncated turn that stays.
    truncated: int = 1

    def __post_init__(self) -> None:
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 0:
            raise ValueError("edits cost 0 or more, insertions more than 0: else a path could insert without end")

    def of(self, initial: str, fault: int) -> Iterator[tuple[str, int, str | None]]:
        """The transducer's arcs for a turn: label, cost, and the initial that comes out (none for a deleted turn)."""
        yield DELETE, self.delete, None
        if fault in (BLANK, DUPLICATE):
            return
        more = self.truncated * (fault == TRUNCATED)
        yield KEEP, more, initial
        for out, _ in self.roles:
            yield REROLE, self.rerole + more, out


@dataclass
class Composition:
    """Turns, edits and grammar composed, as far as it has been asked for.

    From any state a label leads to one other state, else there is a
    ``ValueError``; so of two paths of the same cost the one with the smaller
    label at the first difference has the smaller string.
    """

    grammar: Grammar = DIALOGUE
    edits: Edits = Edits()
    known: dict = field(default_factory=dict)

    def over(self, initial: str, fault: int, q: int) -> list[tuple[str, int, int, str | None]]:
        """Arcs over a turn: label, cost, next state of the grammar, initial that comes out; smallest label first."""
        if (initial, fault, q) not in self.known:
            arcs = []
            for label, cost, out in self.edits.of(initial, fault):
                to = q if out is None else self.grammar.arcs.get((q, out))
                if to is not None:
                    arcs.append((label, cost, to, out))
            self.known[initial, fault, q] = self._checked(arcs)
        return self.known[initial, fault, q]

    def between(self, q: int) -> list[tuple[str, int, int, str | None]]:
        """Arcs between turns: insertions."""
        if q not in self.known:
            self.known[q] = self._checked([(INSERT, self.edits.insert, self.grammar.arcs[q, out], out) for out, _ in self.edits.roles if (q, out) in self.grammar.arcs])
        return self.known[q]

    @staticmethod
    def _checked(arcs: list) -> list:
        if len({a[0] for a in arcs}) < len(arcs):
            raise ValueError("the grammar allows several roles for one edit")
        return sorted(arcs)

    def accept(self) -> list[int]:
        """Costs at the end of a conversation, by state."""
        return [0 if q in self.grammar.accepting else NEVER for q in range(self.grammar.states)]

    def inserted(self, weight: list[int], chosen: list) -> None:
        """Better ``weight`` of the states of one place by insertions, and what they ``chosen``; insertions cost, so states are done in order of their cost."""
        open_ = set(range(len(weight)))
        while open_:
            done = min(open_, key=weight.__getitem__)
            open_.discard(done)
            for q in open_:
                for arc in self.between(q):
                    label, cost, to, _ = arc
                    if to == done and weight[to] < NEVER and (weight[to] + cost, label) < (weight[q], chosen[q][0] if chosen[q] else ""):
                        weight[q], chosen[q] = weight[to] + cost, arc

    def back(self, turns: list[tuple[str, int]], end: list[int], last: bool) -> tuple[list[int], list[list]]:
        """Least costs from each state before ``turns`` to the costs ``end`` after them, and the arc chosen at each place and state."""
        weight, chosen = list(end), [None] * len(end)
        if last:
            self.inserted(weight, chosen)
        places = [chosen]
        for initial, fault in reversed(turns):
            now, chosen = [NEVER] * len(end), [None] * len(end)
            for q in range(len(end)):
                for arc in self.over(initial, fault, q):
                    if arc[1] + weight[arc[2]] < now[q]:  # arcs come by label: the first of the cheapest counts
                        now[q], chosen[q] = arc[1] + weight[arc[2]], arc
            self.inserted(now, chosen)
            weight = now
            places.append(chosen)
        return weight, places[::-1]

    def walk(self, places: list[list], q: int) -> tuple[int, list[tuple[str, str | None, int | None]]]:
        """From state ``q`` along chosen arcs: the state after the last turn, and label, initial and turn's number of each edit."""
        out, i = [], 0
        while (arc := places[i][q]) is not None:
            inserts = arc[0] == INSERT
            out.append((arc[0], arc[3], None if inserts else i))
            q, i = arc[2], i + (not inserts)
        return q, out

    def shortest(self, turns: list[tuple[str, int]]) -> tuple[int, list[tuple[str, str | None, int | None]]]:
        """Cost and edits of the cheapest path over a whole conversation."""
        weight, places = self.back(turns, self.accept(), True)
        return weight[self.grammar.start], self.walk(places, self.grammar.start)[1]

    def matrix(self, turns: list[tuple[str, int]]) -> list[list[int]]:
        """Least costs from each state before ``turns`` to each one after them."""
        n = self.grammar.states
        ends = [self.back(turns, [0 if q == e else NEVER for q in range(n)], False)[0] for e in range(n)]
        return [[ends[e][q] for e in range(n)] for q in range(n)]


def faults(turns: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each different (conversation, turn, role, text), with its ``copies`` and the first ``fault`` of its first copy.

    Copies are counted before anything else moves, and the first turn with a
    role and text by partial minima: neither a conversation nor a text is
    gathered anywhere.
    """
    rows = turns.groupBy(conv, turn, role, text).agg(F.count("*").alias("copies"))
    rows = stored(rows.withColumn("key", F.sha2(F.concat_ws("\0", role, text), 256)), "turns")
    # nulls first: (false, null) is before (true, 5)
    when = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))
    first = rows.groupBy(F.struct(conv).alias("c"), "key").agg(F.min(when).alias("first"))
    end = F.rtrim(F.col(text), F.lit(BLANKS))
    fault = F.when(end == "", BLANK).when(F.col("first") != when, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return rows.withColumn("c", F.struct(conv)).join(first, ["c", "key"]).withColumn("fault", fault).drop("c", "key", "first")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``at``, which numbers them by ``order``, and ``block``; ranges of them are in tasks of like size, so a long conversation is in many."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(out.withColumn("block", F.shiftright("at", BLOCK_BITS)), "placed")


def _fragments(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of each fragment in turn: lists by column; and whether it is the first or the last of its block."""
    rows, last = None, None
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            if rows and row[0] != rows[-1][0]:
                yield rows, last, row[1] != rows[-1][1]
                last, rows = rows[-1][1], []
            rows = rows or []
            rows.append(row)
    if rows:
        yield rows, last, True


def _turns(rows: list[tuple]) -> tuple[list[tuple[str, int]], list[int]]:
    """Turns of a fragment with their faults, copies one by one, and the row of each."""
    turns, place = [], []
    for _, _, at, initial, fault, copies in rows:
        turns.append((initial, fault))
        turns.extend([(initial, BLANK if fault == BLANK else DUPLICATE)] * (copies - 1))
        place.extend([at] * copies)
    return turns, place


COLUMNS = ["frag", "block", "at", "initial", "fault", "copies"]


def _sums(machine: Composition, legal: frozenset[str]):
    """Arrow function: a row for each fragment; with costs from state to state if its conversation may go on in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, before, ends in _fragments(batches, COLUMNS):
            turns, _ = _turns(rows)
            initials = [i for i, _ in turns]
            wrong = sum(a + b not in legal for a, b in zip(initials, initials[1:], strict=False))
            open_ = ends or before != rows[0][1]
            matrix = np.array(machine.matrix(turns), np.int64).ravel().tolist() if open_ else None
            row = {"frag": rows[0][0], "wrong": wrong, "first": initials[0], "final": initials[-1], "matrix": matrix}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("frag", pa.int64()), ("wrong", pa.int64()), ("first", pa.string()), ("final", pa.string()), ("matrix", pa.list_(pa.int64()))]))

    return run


def _paths(machine: Composition):
    """Arrow function: for each state before a fragment the state after it, the cost between and the edits; for a whole conversation only from the start."""
    edit = pa.struct([("label", pa.string()), ("initial", pa.string()), ("at", pa.int64())])
    path = pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("edits", pa.list_(edit))])
    schema = pa.schema([("frag", pa.int64()), ("paths", pa.list_(path))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in _fragments(batches, [*COLUMNS, "end", "last", "alone"]):
            end, last, alone = rows[0][6:]
            turns, place = _turns([r[:6] for r in rows])
            weight, places = machine.back(turns, end, last)
            found = []
            for q in [machine.grammar.start] if alone else range(machine.grammar.states):
                if weight[q] < NEVER:
                    to, edits = machine.walk(places, q)
                    cost = weight[q] - (0 if last else end[to])
                    found.append({"source": q, "target": to, "cost": cost, "edits": [{"label": label, "initial": out, "at": None if i is None else place[i]} for label, out, i in edits]})
            yield pa.RecordBatch.from_pylist([{"frag": rows[0][0], "paths": found}], schema)

    return run


def _ends(machine: Composition):
    """Pandas function over one conversation's fragments: the costs after each, from the last one back."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, out = machine.grammar.states, []
        for i, (frag, matrix) in enumerate(rows.sort_values("frag", ascending=False)[["frag", "matrix"]].itertuples(index=False)):
            if i == 0:
                end = machine.accept()
                first = list(end)
                machine.inserted(first, [None] * n)
            out.append((frag, list(end), i == 0))
            after = np.array(first if i == 0 else end, np.int64)
            end = np.minimum((np.array(matrix, np.int64).reshape(n, n) + after).min(axis=1), NEVER).tolist()
        return pd.DataFrame(out, columns=["frag", "end", "last"])

    return run


def _entered(start: int):
    """Pandas function over one conversation's fragments: the state in which the path enters each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, q = [], start
        for frag, sources, targets in rows.sort_values("frag")[["frag", "sources", "targets"]].itertuples(index=False):
            out.append((frag, q))
            q = dict(zip(sources, targets, strict=True))[q]
        return pd.DataFrame(out, columns=["frag", "entered"])

    return run


@dataclass(frozen=True)
class Repaired:
    """``turns``: ``conv``, ``frag``, ``nth``, ``edit``, ``role``, ``text`` of each edit, in order of ``frag`` and ``nth`` (deleted turns too, with null role and text);
    ``audits``: a row for each conversation with ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``gaps``, ``cost``, ``audit``."""

    turns: DataFrame
    audits: DataFrame


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", grammar: Grammar = DIALOGUE, edits: Edits = Edits(), legal: frozenset[str] = LEGAL) -> Repaired:
    """Repair every conversation by its cheapest edits; of equal cost, those whose initials are the least string.

    Turns go by ``turn_col`` (nulls first), then role and text. The first fault
    of each counts: blank; duplicate (role and text were seen before in the
    conversation); truncated (the last character but blanks is none of ``.!?``).
    Blank and duplicate turns are deleted, truncated ones that stay cost more.

    Rows are numbered in ranges and cut into blocks of 4096. A conversation that
    crosses blocks has a matrix of costs from state to state for each; these few
    numbers, not its turns, come together to find the costs behind each block and
    then the state in which the path enters it. So a conversation with a third of
    all rows is repaired by as many tasks as its blocks.

    Null roles and texts are one space each, null ids one conversation. A role's
    initial is its first character; a role without one fits nowhere. Repeated
    rows are turns of their own. Other columns are ignored, an empty table gives
    empty results.
    """
    machine = Composition(grammar, edits)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # nulls first, as Spark orders ascending
    ordered = placed(faults(rows), [F.col("conv"), F.col("turn"), F.col("role"), F.col("text")])
    # blocks are dealt whole; within one, a conversation's rows are a fragment, named by its first row
    frag = F.min("at").over(Window.partitionBy("block", "conv"))
    slim = ordered.select("conv", "turn", "at", "block", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    slim = stored(slim.repartition("block").withColumn("frag", frag), "slim")
    dealt = lambda df, *more: df.select(*COLUMNS, *more).repartition("block").sortWithinPartitions("at")
    named = slim.groupBy("frag").agg(F.first("conv").alias("conv"), *(F.sum(F.when(F.col("fault") == k, n).otherwise(0)).alias(name) for k, n, name in ((BLANK, F.col("copies"), "blank"), (TRUNCATED, F.lit(1), "truncated"))), F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"))
    sums = dealt(slim).mapInArrow(_sums(machine, legal), "frag long, wrong long, first string, final string, matrix array<long>")
    parts = stored(named.join(sums, "frag"), "parts")
    shared = parts.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("conv").alias("c"))
    several = stored(parts.withColumn("c", F.struct("conv")).join(shared, "c", "left_semi").drop("c"), "several")
    ends = several.select("conv", "frag", "matrix").groupBy("conv").applyInPandas(_ends(machine), "frag long, end array<long>, last boolean")
    alone = F.col("end").isNull()
    known = slim.join(ends, "frag", "left").withColumn("alone", alone).withColumn("last", F.coalesce("last", F.lit(True))).withColumn("end", F.coalesce("end", F.array(*(F.lit(x).cast("long") for x in machine.accept()))))
    path = "array<struct<source: int, target: int, cost: bigint, edits: array<struct<label: string, initial: string, at: bigint>>>>"
    paths = stored(dealt(known, "end", "last", "alone").mapInArrow(_paths(machine), f"frag long, paths {path}"), "paths")
    steps = several.select("conv", "frag").join(paths, "frag").select("conv", "frag", F.col("paths.source").alias("sources"), F.col("paths.target").alias("targets"))
    entered = steps.groupBy("conv").applyInPandas(_entered(grammar.start), "frag long, entered int")
    mine = F.coalesce("entered", F.lit(grammar.start))
    taken = paths.join(entered, "frag", "left").select("frag", F.get(F.filter("paths", lambda p: p["source"] == mine), F.lit(0)).alias("path"))
    taken = stored(taken.join(parts.select("frag", "conv"), "frag").select("conv", "frag", "path.cost", "path.edits"), "taken")

    each = taken.select("conv", "frag", F.posexplode("edits").alias("nth", "e")).select("conv", "frag", "nth", "e.label", "e.initial", "e.at")
    kept = each.join(ordered.select("at", "role", "text"), "at", "left")
    given = F.lit(None).cast("string")
    for initial, role in edits.roles:
        given = F.when(F.col("initial") == initial, role).otherwise(given)
    role = F.when(F.col("label") == KEEP, F.col("role")).when(F.col("label").isin(REROLE, INSERT), given)
    text = F.when(F.col("label") == INSERT, "").when(F.col("label") != DELETE, F.col("text"))
    turns = kept.select("conv", "frag", "nth", F.col("label").alias("edit"), role.alias("role"), text.alias("text"))

    before = F.lag("final").over(Window.partitionBy("conv").orderBy("frag"))
    across = F.when(before.isNotNull() & ~F.concat(before, F.col("first")).isin(*legal), 1).otherwise(0)
    counted = parts.withColumn("across", across).groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("wrong") + F.col("across")).alias("illegal"))
    span = slim.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    piece = F.struct("frag", F.array_join("edits.label", "").alias("piece"))
    edited = taken.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(piece))["piece"], "").alias("audit"))
    c = lambda df: df.withColumn("c", F.struct("conv"))  # noqa: E731  null ids join too
    audits = c(counted).join(c(span).drop("conv"), "c").join(c(edited).drop("conv"), "c").drop("c")
    return Repaired(turns, audits)


def hashed(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines: ``conv``, ``repaired_sha256``.

    A hash takes its bytes in order, so a conversation's turns pass through one
    task; they pass batch by batch, and nothing but the hash's state is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], names=["conv", "repaired_sha256"])
        for b in batches:
            kind = b.schema.field("conv").type
            for own, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if now is None or own != conv:
                    if now is not None:
                        yield done()
                    now, conv = hashlib.sha256(), own
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
        if now is not None:
            yield done()

    kept = turns.where(F.col("edit") != DELETE).select("conv", "frag", "nth", "role", "text")
    schema = kept.select("conv", F.lit("").alias("repaired_sha256")).schema
    return kept.repartition("conv").sortWithinPartitions("conv", "frag", "nth").mapInArrow(run, schema)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conversations`` with known faults, by ``crc32(conv:turn) % 20``: dropped (0), emptied (1), without ``.!?`` (2), repeated (3), said by the user (4).

    Nulls are one space, in ids too. Columns: the four named ones.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    role = F.when(kind == 4, "user").otherwise(space(role_col))
    out = conversations.where(kind != 0).select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")
