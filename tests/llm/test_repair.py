"""Repairs against all edit strings tried one by one, and against a plain search over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_faults(talk):
    seen, out = set(), []
    for role, text in talk:
        found = WORD.findall(text)
        out.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(talk):
    """Forward over places, with all cheapest strings kept for each (role last given, edits): no grammar machine, only the pattern's rule."""
    may = {"": "su", "s": "u", "u": "a", "a": "u"}
    faults = plain_faults(talk)
    best = {"": (0, "", ())}  # by last initial: cost, edits, lines

    def better(table, key, entry):
        # a longer string with the same beginning may still be the smaller one: keep them by their completion, so compare padded
        table.setdefault(key, []).append(entry)

    layers = [{"": [(0, "", ())]}]

    def inserted(table):
        out = {k: list(v) for k, v in table.items()}
        fresh = table
        for _ in range(2):
            new = {}
            for last, entries in fresh.items():
                for i, name in (("u", "user"), ("a", "assistant")):
                    if i in may[last]:
                        for cost, text, lines in entries:
                            better(new, i, (cost + 2, text + "I", (*lines, f"{name}:")))
            for k, v in new.items():
                out.setdefault(k, []).extend(v)
            fresh = new
        return pruned(out)

    def pruned(table):
        """Of each state only the cheapest entries can win: the least string, and those that it begins."""
        out = {}
        for k, v in table.items():
            cheap = [e for e in set(v) if e[0] == min(x[0] for x in v)]
            least = min(e[1] for e in cheap)
            out[k] = [e for e in cheap if e[1].startswith(least)]
        return out

    table = inserted(layers[0])
    for (role, text), fault in zip(talk, faults, strict=True):
        new = {}
        for last, entries in table.items():
            for cost, edits, lines in entries:
                better(new, last, (cost + 3, edits + "D", lines))
                if fault in "t":
                    more = fault == "t"
                    if role[:1] and role[:1] in may[last]:
                        better(new, role[:1], (cost + more, edits + "K", (*lines, f"{role}:{text}")))
                    for i, name in (("u", "user"), ("a", "assistant")):
                        if i in may[last]:
                            better(new, i, (cost + 2 + more, edits + "R", (*lines, f"{name}:{text}")))
        table = inserted(pruned(new))
    ends = [e for k in ("", "a") for e in table.get(k, [])]
    least = min(e[0] for e in ends)
    return min((e for e in ends if e[0] == least), key=lambda e: e[1])


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        talk = [(role, text) for _, _, role, text in turns]
        faults, known = plain_faults(talk), [t for k, t, *_ in turns if k]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        cost, audit, lines = plain_repair(talk)
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(done):
    hashes = {r.conv: r.repaired_sha256 for r in repair.hashed(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv, empty)) for r in done.audits.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, at int")


def talks(n, seed, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \n", "", "x. ", "ab ", None]
    return [(conv, rng.choice([None, *range(longest)]) if rng.random() < 0.2 else t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"{conv} {t}.") for conv in [None, *range(n)] for t in range(rng.randint(1, longest))]


def all_strings(talk):
    """Every string of edits that gives an allowed order, by brute force, with its cost."""
    faults, slots = plain_faults(talk), len(talk) + 1
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    for chosen in itertools.product("KuaD", repeat=len(talk)):
        if any(f in ("b", "d") and c != "D" for f, c in zip(faults, chosen, strict=True)):
            continue
        for between in itertools.product(inserts, repeat=slots):
            if sum(map(len, between)) > 3:
                continue
            order, cost, edits = "", 0, ""
            for i in range(slots):
                order += "".join(between[i])
                edits += "I" * len(between[i])
                cost += 2 * len(between[i])
                if i < len(talk):
                    c, f = chosen[i], faults[i]
                    initial = talk[i][0][:1] or "-"
                    order += "" if c == "D" else initial if c == "K" else c
                    cost += {"K": 0, "D": 3}.get(c, 2) + (f == "t" and c != "D")
                    edits += c if c in "KD" else "R"
            if GRAMMAR.fullmatch(order):
                yield cost, edits


def test_shortest_against_all_strings():
    rng = random.Random(4)
    kinds = {"": repair.NONE, "b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.TRUNCATED}
    machine = repair.Composition()
    for _ in range(60):
        talk = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
        cost, edits = machine.shortest([(r[:1], kinds[f]) for (r, _), f in zip(talk, plain_faults(talk), strict=True)])
        assert (cost, "".join(e[0] for e in edits)) == min(all_strings(talk))
        assert plain_repair(talk)[:2] == min(all_strings(talk))


def test_many_small_conversations(spark):
    rows = talks(300, 1)
    assert got(repair.repaired(frame(spark, rows).repartition(5))) == plain(rows)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_conversations_that_cross_blocks(spark, monkeypatch, bits):
    """Blocks of one, two and eight rows give the rows that whole conversations give."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = talks(25, bits + 2, 14)
    assert got(repair.repaired(frame(spark, rows).repartition(3))) == plain(rows)


def test_one_long_conversation(spark):
    """20,000 turns of one conversation, and a turn that is repeated 5,000 times."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"{t}." if t % 7 else "same.") for t in range(20000)] + [(1, 20000, "user", "again.")] * 5000 + [(2, 0, "user", "x.")]
    done = repair.repaired(frame(spark, rows).repartition(8))
    found = got(done)
    talk = [r[2:] for r in rows if r[0] == 1]
    kinds = {"": repair.NONE, "b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.TRUNCATED}
    faults = plain_faults(talk)
    cost, edits = repair.Composition().shortest([(r[:1], kinds[f]) for (r, _), f in zip(talk, faults, strict=True)])
    names, lines = {"u": "user", "a": "assistant"}, []
    for label, initial, i in edits:
        if label != "D":
            lines.append(f"{talk[i][0] if label == 'K' else names[initial]}:{'' if label == 'I' else talk[i][1]}")
    assert found[1] == (0, 0, faults.count("d"), 0, found[1][4], cost, "".join(e[0] for e in edits), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert found[1][4] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
    assert found[2] == plain(rows[-1:])[2]
    assert done.turns.where("conv = 1").select("frag").distinct().count() >= 5


def test_damage(spark):
    rows = [(c, t, r, x) for c, t, r, x in talks(200, 9) if c is not None] + [(None, None, None, None), (None, 3, "user", "a.")]
    out = repair.damaged(frame(spark, rows))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(plain_damaged(rows), key=key)
    assert repair.damaged(frame(spark, rows).limit(0)).collect() == []


def test_empty_tables(spark):
    done = repair.repaired(frame(spark, [(1, 1, "user", "x")]).limit(0))
    assert done.audits.collect() == [] and done.turns.collect() == [] and repair.hashed(done.turns).collect() == []


def test_other_grammars_and_costs():
    machine = repair.Composition(repair.Grammar({(0, "u"): 1, (1, "a"): 0}, frozenset({0})), repair.Edits(rerole=5, delete=1, insert=4))
    assert machine.shortest([("u", 0), ("u", 0)]) == (2, [("D", None, 0), ("D", None, 1)])
    with pytest.raises(ValueError):
        repair.Edits(insert=0)
    with pytest.raises(ValueError):  # two roles for one label
        repair.Composition(repair.Grammar({(0, "u"): 1, (0, "a"): 1}, frozenset({1}))).shortest([("u", 0)])


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    out = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_repair"](spark, folder).collect()}
    assert out == {r[0]: want.get(r[0], empty) for r in rows}


def test_query_against_sql():
    import duckdb

    from tidemark.llm.queries import ORACLES

    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for seed in (1, 2):
        rows = talks(150, seed)
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = plain(plain_damaged(rows))
        assert {r[0]: r[1:] for r in con.execute(ORACLES["op11_repair"]).fetchall()} == {r[0]: want.get(r[0], empty) for r in rows}
