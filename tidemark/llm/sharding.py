"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import stored

#: Bits of a key's hash: the first 15 hex digits of its md5, which any engine can compute.
BITS = 60
#: Bits added to the directory at a time, at most.
STEP = 6
#: A directory of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def key_hash(col: Column) -> Column:
    """The hash string of a key as a long of ``BITS`` bits; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(hash_col: Column, depth) -> Column:
    return _right(hash_col, F.lit(BITS) - depth)


def _right(col: Column, by: Column) -> Column:
    return F.call_function("shiftright", col, by.cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets (``depth``, ``prefix``, ``bytes``, ``whole``) of a table of ``h`` and ``bytes``.

    Starts with one bucket of depth 0. Only buckets over ``limit`` bytes split,
    on one more bit of the hash, until all fit (``whole``) or have a single hash
    left; empty halves are left out. Up to ``STEP`` splits, one more than the
    largest bucket needs if its bytes spread evenly, are worked out together:
    the rows of oversized buckets are summed by their next bits once, and the
    sums in between come from these. So the rows are read once for every few
    bits, and a hot key is summed before it moves.
    """
    told = [F.sum("bytes").cast("long").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    split = lambda b, lo, hi: (F.col(b) > limit) & (F.col(lo) < F.col(hi))
    leaf = sizes.select("h", "bytes", F.col("h").alias("lo"), F.col("h").alias("hi"))
    top = leaf.agg(*told).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes", "lo", "hi").where("lo is not null")
    made, done, at = stored(top, "buckets"), [], 0
    while True:
        done.append(made.where(~split("bytes", "lo", "hi")))
        large = made.where(split("bytes", "lo", "hi") & (F.col("depth") == at)).select("prefix", "bytes")
        most = large.agg(F.max("bytes")).first()[0]
        if at == BITS or most is None:
            break
        large, low = large.select("prefix"), min(at + min(STEP, ceil(log2(most / max(limit, 1))) + 1), BITS)
        inside = leaf.withColumn("prefix", prefix(F.col("h"), F.lit(at))).join(_small(large), "prefix", "left_semi")
        fine = stored(inside.groupBy(prefix(F.col("h"), F.lit(low)).alias("fine")).agg(*told), "fine")
        sums = fine.withColumn("depth", F.explode(F.sequence(F.lit(at + 1), F.lit(low))))
        sums = sums.groupBy("depth", _right(F.col("fine"), F.lit(low) - F.col("depth")).alias("prefix")).agg(*told)
        parents = sums.where(split("bytes", "lo", "hi")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("p"), F.lit(True).alias("open"))
        joined = sums.withColumn("p", _right(F.col("prefix"), F.lit(1))).join(parents, ["depth", "p"], "left")
        made = stored(joined.where((F.col("depth") == at + 1) | F.col("open")).select("depth", "prefix", "bytes", "lo", "hi"), "buckets")
        at = low
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return stored(out.select("depth", "prefix", "bytes", (F.col("bytes") <= limit).alias("whole")), "directory")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size has been checked; leave a larger one to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shards(docs: DataFrame, limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every document, so that no shard's texts exceed ``limit`` bytes (UTF-8).

    Columns: ``id_col``, ``bytes``, ``depth`` (bits of the shard's prefix),
    ``prefix``, ``part`` and ``shard_bytes``. A shard is (``depth``,
    ``prefix``, ``part``). ``part`` is 0 but for buckets which no bit can split,
    as their rows have one and the same key: these are cut by their running
    bytes, so only a text that is over the limit by itself is over it, alone in
    its shard. A null text has 0 bytes; null ids share a key; repeated rows
    stay; other columns are ignored; an empty table gives an empty result.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")).withColumn("h", key_hash(F.col("id"))), "sizes")
    buckets = directory(sizes, limit)
    # a row asks at each depth that occurs, a number bounded by the bits of a hash, and one bucket answers
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]
    asked = sizes.withColumn("depth", F.explode(F.array(*map(F.lit, depths)).cast("array<int>"))).withColumn("prefix", prefix(F.col("h"), F.col("depth")))
    found = asked.join(_small(buckets.withColumnRenamed("bytes", "shard_bytes")), ["depth", "prefix"])
    out = found.where("whole").select("id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("part"), "shard_bytes")
    if buckets.where("not whole").limit(1).count():
        out = out.union(_cut(found.where("not whole"), limit))
    return out.select(F.col("id").alias(id_col), "bytes", "depth", "prefix", "part", "shard_bytes")


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of one key's rows: equal sizes together, so many to a part as fit. Sizes are summed before they meet."""
    rows = stored(rows.select("id", "bytes", "depth", "prefix", F.monotonically_increasing_id().alias("rid")), "same")
    key = ["depth", "prefix", "bytes"]
    task = _right(F.col("rid"), F.lit(33))
    local = Window.partitionBy(*key, "task").orderBy("rid")
    numbered = rows.withColumn("task", task).withColumn("nth", F.row_number().over(local) - 1)
    counts = rows.withColumn("task", task).groupBy(*key, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))), F.lit(1))
    sizes = counts.groupBy(*key).agg(F.sum("n").alias("n")).withColumn("each", each).withColumn("parts", F.ceil(F.col("n") / F.col("each")))
    order = Window.partitionBy("depth", "prefix").orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("from", F.coalesce(F.sum("parts").over(order), F.lit(0)))
    placed = numbered.join(base, [*key, "task"]).join(sizes, key).withColumn("rank", F.col("base") + F.col("nth"))
    local_part = F.floor(F.col("rank") / F.col("each"))
    filled = F.least(F.col("each"), F.col("n") - local_part * F.col("each"))
    return placed.select("id", "bytes", "depth", "prefix", (F.col("from") + local_part).cast("long").alias("part"), (filled * F.col("bytes")).cast("long").alias("shard_bytes"))
