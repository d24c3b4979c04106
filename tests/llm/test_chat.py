import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

ODD = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "\\", "\\\\<|", "<\\|im_end|>", "ends <", "|starts", "\n\n", "<<|im_end|>", "a\\n\\", "漢字🎉", "$1 \\$", "x" * 50_000, " \t "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_plain_python(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rng = random.Random(4)
    rows = []
    for c in range(30):
        rows += [(c, t if rng.random() < 0.9 else 3, rng.choice(["user", "assistant", "system", "a\nb", "\\x\n", "", None]), rng.choice([*ODD, None]), "x") for t in range(rng.choice([1, 2, 9, 70]))]
    rows += [(None, 1, "user", "lost", "x"), (None, None, "assistant", "rows", None), (7, 1, "user", "again", "x"), (7, 1, "user", "again", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op10_chat"](spark, str(tmp_path)).collect()
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said, ""), (-1, 1, "assistant", said, "")]
    by = defaultdict(list)
    for c, *turn, _ in rows:
        by[c].append(turn)
    assert len(out) == len(by)
    none_first = lambda t: [(x is not None, x if x is not None else 0) for x in t]
    for r in out:
        turns = [(role or "", text or "") for _, role, text in sorted(by[r.conv_id], key=none_first)]
        learned = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
        assert r.formatted_chars >= sum(len(text) + len(role) for role, text in turns)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_against_all_paths(spark, seed):
    rng = random.Random(seed)
    rows, parents = [], {}
    for tree in range(6):
        n = rng.choice([1, 2, 40])
        for node in range(n):
            parent = None if node == 0 or rng.random() < 0.03 else rng.randrange(max(0, node - 4), node)
            parents[tree, node] = parent
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), rng.choice(ODD[:8]), rng.random()))
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, worth double")
    rows = {r[:2]: r for r in rows}
    inner = {(t, p) for (t, _), p in parents.items()}
    want = []
    for tree in range(6):
        found = []
        for t, leaf in parents:
            if t == tree and (t, leaf) not in inner:
                path, at = [], leaf
                while at is not None:
                    path.insert(0, at)
                    at = parents[t, at]
                found.append((-sum(rows[t, n][5] for n in path), -len(path), leaf, path))
        for rank, (*_, leaf, path) in enumerate(sorted(found)[:3], 1):
            want += [(tree, rank, leaf, i, rows[tree, n][3], rows[tree, n][4]) for i, n in enumerate(path)]
    got = chat.paths(nodes, 3, F.col("worth"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    for r in chat.formatted(got).select(chat.read_turns(F.col("formatted")).alias("t"), "tree", "rank").collect():
        assert [tuple(x) for x in r.t] == [w[4:] for w in want if w[:2] == (r.tree, r.rank)]


def test_circles_and_empty_tables(spark):
    nodes = spark.createDataFrame([(1, 1, 2, "user", "a"), (1, 2, 1, "user", "b")], "tree long, node long, parent long, role string, text string")
    assert chat.format_trees(nodes).collect() == []  # no root, no path
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_trees(chat.chains(turns)).collect() == []


def test_repeated_nodes_and_circles(spark):
    """A doubled root adds no turns, and a circle in one tree leaves the others as they are."""
    rows = [(1, 1, None, "user", "hi"), (1, 1, None, "user", "hi"), (1, 2, 1, "assistant", "yes"), (1, 2, 1, "assistant", "yes")]
    rows += [(2, 1, 3, "user", "a"), (2, 2, 1, "user", "b"), (2, 3, 2, "user", "c"), (2, 4, 3, "user", "below"), (2, 5, None, "user", "alone")]
    rows += [(3, 1, None, None, None), (None, 1, None, "user", "no tree")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string")
    out = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat.format_trees(nodes).select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert out == {1: [("user", "hi"), ("assistant", "yes")], 2: [("user", "alone")], 3: [("", "")], None: [("user", "no tree")]}
    assert chat.format_trees(nodes.limit(0)).collect() == []
