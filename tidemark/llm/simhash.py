"""SimHash near-duplicates: fingerprints linked through a segment-popcount grid."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components
from tidemark.llm.util import discard, fresh, sliced, stored, strings

SEED = 42
BITS = 64
#: Bits of a segment; the popcounts (0 to 4) of the 16 segments are the nibbles of one long.
SEGMENT = 4


@dataclass(frozen=True)
class Near:
    """What counts as near in ``near_dedup``, and how candidates are found.

    Two texts are near if their sets of shingles of ``words`` words have a
    Jaccard similarity of ``similarity`` or more. Candidates share some key: a
    fixed choice of bits of a long fingerprint (of shingles of two words, which
    an edit changes less), ``spare`` more than it takes to number the texts,
    so that unlike texts seldom share one. ``tries`` is how often a near pair, ``apart`` of whose bits differ, is
    expected to share a key. Candidates over ``radius`` bits apart are left out.
    """

    words: int = 5
    similarity: float = 0.8
    parts: int = 4
    spare: int = 8
    apart: float = 0.085
    tries: float = 5.0
    radius: int = 48

    def keys(self, texts: int) -> np.ndarray:
        """The bits that make each key: one row for each."""
        bits = min(60, ceil(log2(max(texts, 2))) + self.spare)
        rng = np.random.default_rng(SEED)
        return np.stack([rng.choice(BITS * self.parts, bits, replace=False) for _ in range(ceil(self.tries / (1 - self.apart) ** bits))])


def joined_shingles(found: list[bytes], words: int) -> Iterable[bytes]:
    """A text's shingles, repeats included; the whole sequence where it is shorter than one."""
    return [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, unsigned; zero without words.

    Only A-Z are lower-cased and only ASCII white space separates words, which
    is what these methods of ``bytes`` do. A bit is set if over half of the
    shingles' hashes (repeats included) have it.
    """
    found = text.encode("utf-8").lower().split()
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined_shingles(found, words)), "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long; a null text counts as empty, a column ``name`` is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t, words) for t in strings(b.column(at))], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def popcounts(fp: Column) -> Column:
    """The embedding: each nibble of the result is the number of bits set in that nibble of ``fp``."""
    bits = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(0x1111111111111111)) for i in range(SEGMENT)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def ball(cell: Column) -> Column:
    """The grid cells at Manhattan distance at most one of ``cell``, itself included."""
    steps = []
    for j in range(BITS // SEGMENT):
        count = F.shiftrightunsigned(cell, SEGMENT * j).bitwiseAND(F.lit(15))
        one = F.lit(1 << (SEGMENT * j))
        steps += [F.when(count < SEGMENT, cell + one), F.when(count > 0, cell - one)]
    return F.array_compact(F.array(cell, *steps))


def linked(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints ``fp`` at ``max_distance`` (0 to 2) or fewer differing bits.

    The distance of two fingerprints is at least the Manhattan distance of
    their popcount vectors, so both lie within one step of some shared grid
    cell. Cells that hold a single fingerprint are dropped. In the others each
    fingerprint is refined to the bit patterns of that cell which differ from
    it in one bit at most: two fingerprints share such a pattern exactly if
    they differ in two bits at most. Every pattern links its fingerprints to
    the smallest, so a group of n near copies makes n links and not all pairs.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    own = popcounts(F.col("fp"))
    if max_distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    grid = fps.select("fp", F.explode(ball(own)).alias("cell"))
    shared = grid.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    near = grid.join(shared, "cell", "left_semi").withColumn("step", F.col("cell") - own)
    first = F.bit_count(F.abs("step") - 1)
    masks = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (first + i).cast("int")))
    flips = F.filter(masks, lambda m: (F.col("fp").bitwiseAND(m) == 0) == (F.col("step") > 0))
    patterns = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))
    exact = stored(near.select("fp", F.explode(patterns).alias("pattern")), "patterns")
    if max_distance == 1:  # one bit away is another fingerprint itself
        there = fps.select(F.col("fp").alias("b"))
        return exact.join(there, exact["pattern"] == there["b"]).select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    least = stored(exact.groupBy("pattern").agg(F.min("fp").alias("m"), F.max("fp").alias("hi")).where("m <> hi").select("pattern", "m"), "least")
    links = exact.join(least, "pattern").select(F.col("fp").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def components(marked: DataFrame, id_col: str, max_distance: int = 2) -> DataFrame:
    """For a stored table with ``fp``: each ``fp`` with ``component_id``, the smallest ``id_col`` of its component."""
    fps = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fps")
    labels = stored(connected_components(linked(fps, max_distance)).withColumnRenamed("node", "fp"), "labels")
    ids = labels.join(fps, "fp")
    least = stored(ids.groupBy("component").agg(F.min("least_id").alias("component_id")), "ids")
    joined = stored(labels.join(least, "component").select("fp", "component_id"), "joined")
    return stored(fps.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "classes")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links, its own included;
    fingerprints link at ``max_distance`` or fewer differing bits.
    Null or empty texts have fingerprint zero, which links like any other.
    Repeated rows stay repeated. A null id is never the smallest unless all of
    the component are null. Other columns are ignored; an empty table gives an
    empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(with_fingerprint(slim, "text", words).select("id", "fp"), "fingerprints")
    classes = components(marked, "id", max_distance)
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of smallest id (null ids last).

    Of rows that tie, repeated rows for instance, exactly one stays. All
    columns and their values stay as they are; an empty table stays empty.
    """
    fp, rid = fresh(docs, "fp"), fresh(docs, "rid")
    whole = with_fingerprint(docs, text_col, words, fp).withColumn(rid, F.monotonically_increasing_id())
    whole = stored(whole, "marked")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid"))
    marked = whole.select(F.col(fp).alias("fp"), key.alias("key"))
    kept = components(marked, "key", max_distance).groupBy("component_id.rid").agg(F.lit(1).alias("one")).select(F.col("rid").alias(rid))
    # whatever its size, the table of kept rows is dealt by a key of even spread, and never broadcast
    return whole.join(stored(kept, "kept").hint("shuffle_hash"), rid, "left_semi").select(*docs.columns)


def long_fingerprint(found: list[bytes], parts: int, words: int = 2) -> np.ndarray:
    """SimHash of a text's shingles in ``parts`` times 64 bits, the hash of a shingle being mixed anew for each part."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined_shingles(found, words)), "<u8")
    out = np.zeros(parts, "<u8")
    for i in range(parts):
        with np.errstate(over="ignore"):
            h = hashes + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def shingle_set(found: list[bytes], words: int) -> np.ndarray:
    """32-bit hashes of a text's distinct shingles."""
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(s, SEED) for s in joined_shingles(found, words)), "<u4")).view(np.int32)


#: A table of so many row numbers at most is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _checked(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if counted few, or else to be dealt out: row numbers have an even spread."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids.hint("shuffle_hash")


#: Buckets of a sketch: how many of a text's shingles fall into each, up to 255.
SKETCH = 256


def sketch(shingles: np.ndarray) -> bytes:
    """A text's shingles counted in buckets. The Manhattan distance of two sketches is never more than the number of shingles in one text alone."""
    return np.minimum(np.bincount(shingles & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def near_links(whole: DataFrame, classes: DataFrame, text_col: str, rid: str, near: Near) -> DataFrame:
    """Links (``a``, ``b``) of classes ``c`` whose texts are near.

    The members of a key are compared with its smallest and its largest. Then
    those of them that these links leave in different groups are compared with each
    other, in blocks (``_inner``). The distance of popcount vectors, then that of the
    fingerprints, and among many that of sketches, rules out candidates; shingles decide on the others.
    """
    chosen = near.keys(classes.count())
    signs = [f"s{i}" for i in range(near.parts)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            words = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1).astype("<i8")
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            for i, own in enumerate(chosen):
                value = np.packbits(bits[:, own], axis=1)
                value = np.ascontiguousarray(np.pad(value, ((0, 0), (0, 8 - value.shape[1])))).view("<u8")[:, 0]
                with np.errstate(over="ignore"):
                    key = (value ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["key", "c"])

    keys = classes.select("c", *signs).mapInArrow(keyed, "key long, c long")
    ends = stored(keys.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi"), "ends")
    pairs = keys.join(ends, "key")
    inner = stored(pairs.where("c <> lo and c <> hi").select("key", "c"), "inner")
    pairs = pairs.select("c", F.explode(F.array("lo", "hi")).alias("b")).where("c <> b")
    pairs = pairs_made = stored(pairs.select(F.greatest("c", "b").alias("a"), F.least("c", "b").alias("b")).distinct(), "pairs")
    of = F.struct(*signs, *(popcounts(F.col(s)).alias(f"p_{s}") for s in signs))
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("c").alias(side), of.alias(f"of_{side}")), side)
    at_least = sum(manhattan(F.col(f"of_a.p_{s}"), F.col(f"of_b.p_{s}")) for s in signs)
    exact = sum(F.bit_count(F.col(f"of_a.{s}").bitwiseXOR(F.col(f"of_b.{s}"))) for s in signs)
    close = pairs.where(at_least <= near.radius).where(exact <= near.radius)
    close = stored(close.select("a", "b", exact.cast("int").alias("off")), "close")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(t.encode("utf-8").lower().split(), near.words) for t in strings(b.column(1))]
            more = [pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32())), *more], names=["c", "shingles", "size", "sketch"])

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(ids.toDF(rid).distinct(), "wanted")
        texts = whole.select(rid, text_col).join(_checked(wanted), rid, "left_semi")
        sets = stored(texts.mapInArrow(shingled, "c long, shingles array<int>, size int, sketch binary"), "shingles")
        discard(wanted)
        return sets

    def decided(some: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("b", "a"):
            some = some.join(sets.select(F.col("c").alias(side), F.col("shingles").alias(f"of_{side}")), side)
        shared = F.size(F.array_intersect("of_a", "of_b"))
        return stored(some.where(shared >= near.similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"), "near")

    def settled(close: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
        # each with its nearest first: of the other candidates, those within a group so found can add nothing
        first = decided(close.groupBy("a").agg(F.min(F.struct("off", "b")).alias("m")).select("a", F.col("m.b").alias("b")), sets)
        links = first if known is None else known.union(first)
        groups = stored(connected_components(links), "groups")
        rest = close.select("a", "b")
        for side in ("a", "b"):
            rest = rest.join(groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        return links.union(decided(rest, sets))

    links = settled(close, sets_of(close.select("a").union(close.select("b"))))
    dealt = _dealt(inner, stored(connected_components(links), "groups"))
    discard(ends, inner, pairs_made)
    if dealt.limit(1).count():
        sets = sets_of(dealt.select("c"))
        links = settled(_inner(dealt, classes.select("c", *signs), sets, near), sets, links)
    return links


#: Members of a key that are compared with each other in one block.
BLOCK = 512


def _dealt(inner: DataFrame, groups: DataFrame) -> DataFrame:
    """Members ``c`` of the keys whose members are in different groups ``g``, each with its block ``own`` of ``blocks``."""
    labelled = inner.join(groups.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("g"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = stored(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    own = F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int")
    dealt = stored(labelled.join(mixed, "key").withColumn("own", own), "dealt")
    discard(labelled, mixed)
    return dealt


def _inner(dealt: DataFrame, classes: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Candidates (``a``, ``b``) among members of the same key that are in different groups; ``off`` is the distance of their sketches.

    Every two blocks of a key meet by themselves: as many rows for each member as there are
    blocks, and no key comes together. Pairs are made within a task only, and
    those whose fingerprints and sketches leave it open whether they are near go on. A pair of
    texts of ``n`` and ``m`` shingles is near if at most (n + m) (1 - similarity) / (1 + similarity)
    of these are in one text alone, so no near pair is ruled out by sketches.
    """
    signs = classes.columns[1:]
    most = (1 - near.similarity) / (1 + near.similarity)
    radius = near.radius

    def compared(block: pa.Table) -> pa.Table:
        c, g, own, size = (block[n].to_numpy() for n in ("c", "g", "own", "size"))
        fps = np.stack([block[s].to_numpy() for s in signs], axis=1).view("<u8")
        counts = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(len(c), -1).astype(np.int16)
        i, j = block["i"][0].as_py(), block["j"][0].as_py()
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(one), 32):
            part = one[at : at + 32]
            x, y = np.nonzero((g[part][:, None] != g[two]) & ((i < j) | (c[part][:, None] < c[two])))
            x, y = part[x], two[y]
            open_ = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1) <= radius
            x, y = x[open_], y[open_]
            off = np.abs(counts[x] - counts[y]).sum(axis=1, dtype=np.int64)
            open_ = off <= most * (size[x].astype(np.int64) + size[y]) + 1e-6
            x, y, off = x[open_], y[open_], off[open_]
            found.append(np.stack([np.maximum(c[x], c[y]), np.minimum(c[x], c[y]), off]))
        a, b, off = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b, "off": off.astype(np.int32)})

    own, other = F.col("own"), F.col("other")
    rows = dealt.join(classes, "c").join(sets.select("c", "size", "sketch"), "c")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "own", "c", "g", "size", "sketch", *signs)
    return stored(rows.groupBy("key", "i", "j").applyInArrow(compared, "a long, b long, off int").distinct(), "met")


def manhattan(x: Column, y: Column) -> Column:
    """The Manhattan distance of two embeddings, which is never more than the number of bits that differ."""
    each = lambda n: F.lit(int.from_bytes([n] * 8))

    def half(c: Column, j: int) -> Column:
        """Every other segment's count, in a byte each."""
        return F.shiftrightunsigned(c, SEGMENT * j).bitwiseAND(each(15))

    total = F.lit(0).cast("long")
    for j in (0, 1):
        v = half(x, j) + each(8) - half(y, j)  # the difference, and 8
        more = F.shiftrightunsigned(v, 3).bitwiseAND(each(1))
        less = each(1) - more
        total = total + v.bitwiseAND(more * 7) + v.bitwiseXOR(each(7)).bitwiseAND(less * 7) + less
    return total % 255  # the sum of its bytes


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near | None = None) -> DataFrame:
    """``docs`` with one row of each group of near texts: the one of smallest id (null ids last).

    Near texts share 0.8 of their five-word shingles (``Near``); groups are what such
    links connect. Texts of the same words, but for case of A-Z and ASCII white
    space, are one class and meet as such, null, empty and blank ones in
    one class; only classes are compared. Of rows that tie, repeated rows for instance, exactly one
    stays. All columns and their values stay as they are; an empty table stays empty.
    """
    near = near or Near()
    rid, hi, lo = fresh(docs, "rid"), fresh(docs, "hi"), fresh(docs, "lo")
    signs = [fresh(docs, f"s{i}") for i in range(near.parts)]
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = [t.encode("utf-8").lower().split() for t in strings(b.column(at))]
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), np.int64).reshape(-1, 2)
            own = np.stack([long_fingerprint(w, near.parts) for w in words]).view(np.int64)
            more = [*same.T, *own.T]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m) for m in more)], [*b.schema.names, hi, lo, *signs])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in (hi, lo, *signs))])
    whole = stored(docs.mapInArrow(marked, schema).withColumn(rid, F.monotonically_increasing_id()), "marked")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid"))
    first = whole.groupBy(hi, lo).agg(F.min(key).alias("key"), *(F.first(s).alias(f"s{i}") for i, s in enumerate(signs)))
    classes = stored(first.select(F.col("key.rid").alias("c"), "*").drop(hi, lo), "classes")
    links = near_links(whole, classes, text_col, rid, near)
    joined = stored(connected_components(links), "joined")
    best = joined.join(classes.select(F.col("c").alias("node"), "key"), "node").groupBy("component").agg(F.min("key").alias("key"))
    stays = stored(best.select(F.col("key.rid").alias(rid)), "stays")
    kept = classes.select(F.col("c").alias(rid)).join(joined.select(F.col("node").alias(rid)), rid, "left_anti").union(stays)
    gone = stored(whole.select(rid).join(kept, rid, "left_anti"), "gone")
    return whole.join(_checked(gone), rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
