"""Chat formatting of reply trees, in DataFrame and SQL functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.pii import running
from tidemark.llm.util import stored

START, END = "<|im_start|>", "<|im_end|>"
SPANS = "array<struct<start:int,stop:int>>"


def escape(text: Column) -> Column:
    r"""Put a backslash before every backslash, and one inside every ``<|``, so that no text holds a control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` or ``escape_role`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a backslash before every line break: the first plain one ends a role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in rows by turn, as reply trees without branches: ``tree``, ``node``, ``parent``, ``role``, ``text``.

    Each row replies to the one before it. Rows of one turn go by role, then
    text; a null turn, role or text comes first. Rows whose conversation is null
    make one conversation. Null roles and texts become empty.
    """
    order = Window.partitionBy(conv_col).orderBy(*(F.col(c).asc_nulls_first() for c in (turn_col, role_col, text_col)))
    node = F.row_number().over(order).cast("long")
    rows = turns.select(F.col(conv_col).alias("tree"), node.alias("node"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def rooted(shape: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node's depth and score summed from the root, by self-joins that double the reach of each round.

    Returns (``tree``, ``node``, ``depth``, ``total``), and the table of every
    round: for each node that has one its ancestor 2**k steps up. A tree of
    depth d takes log2(d) rounds, and a round joins only the nodes that have
    not reached their root. Nodes whose parent isn't there count as roots; those
    whose parents go round in a circle have no root and are left out.
    """
    there = shape.select(F.col("tree").alias("t"), F.col("node").alias("above"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    hop = shape.join(there, same("tree", "t") & (F.col("parent") == F.col("above")), "left")
    hop = stored(hop.select("tree", "node", F.col("above").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "hops")
    ended, hops, most = [hop.where("up is null")], [], hop.count().bit_length()
    while (open_ := hop.where("up is not null")).limit(1).count():
        if len(hops) > most:  # what is open now goes round in a circle
            break
        hops.append(open_)
        known = open_
        for e in ended:
            known = known.union(e)
        far = known.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("depth").alias("d"), F.col("total").alias("s"))
        joined = open_.join(far, same("tree", "t") & (F.col("up") == F.col("n")))
        hop = stored(joined.select("tree", "node", F.col("further").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total")), "hops")
        ended.append(hop.where("up is null"))
    sums = ended[0]
    for e in ended[1:]:
        sums = sums.union(e)
    return sums.select("tree", "node", "depth", "total"), hops


def once_each(nodes: DataFrame) -> DataFrame:
    """One row for each ``node`` of a ``tree``: of repeated ones the first by parent, role and text."""
    first = F.min(F.struct(*(F.struct(F.col(c).isNull(), F.col(c).alias("v")).alias(c) for c in ("parent", "role", "text"))))
    return nodes.groupBy("tree", "node").agg(first.alias("n")).select("tree", "node", *(F.col(f"n.{c}.v").alias(c) for c in ("parent", "role", "text")))


def paths(nodes: DataFrame, best: int = 1, score: Column | None = None) -> DataFrame:
    """The ``best`` root-to-leaf paths of every tree, by summed score: ``tree``, ``rank``, ``leaf``, ``at``, ``role``, ``text``.

    ``nodes`` has ``tree``, ``node`` (a long, once in its tree), ``parent``
    (null at a root), ``role`` and ``text``; tables where nodes may repeat go through ``once_each``
    first, as ``format_trees`` does. Nodes on a circle of replies, and those below them, are on no
    path. Null trees are one tree; an empty table gives an empty result. ``at`` counts from 0 at the root.
    Without ``score`` a node scores the length of its text. Paths of the same
    score go by depth, deeper first, then by leaf. From the chosen leaves, the
    nodes above are enumerated with the tables of all rounds, longest steps
    first, so the rows at any time are those of chosen paths. The shape of the
    trees is stored once, without texts; these are joined at the end.
    """
    worth = (F.length("text") if score is None else score).cast("double").alias("score")
    shape = stored(nodes.select("tree", "node", "parent", worth), "shape")
    sums, hops = rooted(shape)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    inner = shape.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = sums.join(inner, same("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("depth").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    on_path = stored(chosen.select("tree", "rank", F.col("node").alias("leaf"), "node"), "paths")
    for hop in reversed(hops):
        step = hop.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = on_path.join(step, same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "rank", "leaf", F.col("up").alias("node"))
        on_path = stored(on_path.union(above), "paths")
    depths = sums.select(F.col("tree").alias("t"), F.col("node").alias("n"), (F.col("depth") - 1).alias("at"))
    texts = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    found = on_path.join(depths, same("tree", "t") & (F.col("node") == F.col("n"))).join(texts, same("tree", "t2") & (F.col("node") == F.col("n2")))
    return found.select("tree", "rank", "leaf", "at", "role", "text")


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row for each path of ``paths``: ``tree``, ``rank``, ``formatted`` and ``loss``.

    A turn is ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and
    a line break, with texts and roles escaped; null roles and texts count as empty. ``loss`` has the spans (code
    points, end exclusive) of the texts, as escaped, of role ``learn``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("at", escape_role(role).alias("role"), escape(text).alias("text"), (role == learn).alias("learn"))
    rows = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head, tail = len(START) + 1, len(END) + 1
    sizes = F.transform("turns", lambda t: F.length(t["role"]) + F.length(t["text"]) + head + tail)
    ends = running(sizes, lambda a, b: a + b)
    spans = F.transform("turns", lambda t, i: F.struct((F.get("ends", i) - tail - F.length(t["text"])).alias("start"), (F.get("ends", i) - tail).alias("stop"), t["learn"].alias("learn")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: s.dropFields("learn")).cast(SPANS)
    return rows.withColumn("ends", ends).select("tree", "rank", whole.alias("formatted"), loss.alias("loss"))


def format_trees(nodes: DataFrame, best: int = 1, score: Column | None = None, learn: str = "assistant", repeats: bool = True) -> DataFrame:
    """Reply trees to conversations: the ``best`` paths of every tree, each one formatted.

    Repeated nodes count once; ``repeats`` may be False where there are none, as from ``chains``. ``score`` is of ``parent``, ``role`` and ``text``.
    """
    return formatted(paths(once_each(nodes) if repeats else nodes, best, score), learn)


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation: an array of structs ``role``, ``text``."""
    parts = F.split(text, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(START) + 1, F.length(p)))
    role = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
    return F.transform(bodies, lambda b: F.struct(unescape(F.regexp_extract(b, role, 1)).alias("role"), unescape(F.regexp_replace(b, role, "")).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))), "")
