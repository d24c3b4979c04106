import hashlib
import random
import re
import time
from itertools import accumulate

from pyspark.sql import functions as F

from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(3)
    parts = ["a", "B7", "@", "@", ".", ".", "-", "_", "%", "+", "+1", " ", " ", "é", "🎉", "4111111111111111", "4111 1111-1111 1111", "0", "12", "255", "256", "1.2.3.4", "001.2.3.4", "(523)", "555-1055", "x@y.zz", "\n", "::"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(600)]
    return out + [None, "", "a" * 60000, "a@b" * 3000, "1." * 20000, "1 " * 20000, "a@" + "b." * 20000 + "c", "+1" * 20000, "+1" + "(" * 30000, "x@y.zz, " * 800, "GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32", "my ssn 123-45-6789 here", "part 123-45-6789 here"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, found_email string")


def test_base_spans(spark):
    rows = texts()
    out = pii.with_spans(frame(spark, rows)).select("doc_id", pii.listed("spans", pii.BASE).alias("s"), pii.listed("spans", pii.BASE + pii.MORE).alias("more")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.s == ",".join(plain(rows[r.doc_id])), repr(rows[r.doc_id])[:200]
        assert r.more.startswith(r.s)
    more = {r.doc_id: r.more for r in out}
    n = len(rows)
    assert "iban:0:27" in more[n - 3] and more[n - 3].count("iban") == 1
    assert more[n - 2] == "national_id:7:18" and more[n - 1] == ""


def test_redacted_texts(spark):
    rows = texts()
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    spans = {r.doc_id: sorted((s.start, s.stop, s.kind) for k in r.spans for s in k) for r in pii.with_spans(docs).collect()}
    for i, t in enumerate(rows):
        want, at = "", 0
        for n, (a, b, kind) in enumerate(spans[i]):
            if n and a < at:
                at = max(at, b)
                continue
            want += t[at:a] + f"[{kind.upper()}]"
            at = b
        assert out[i].text == (None if t is None else want + t[at:])
        assert out[i].found_email == "k"


def test_query_digest(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows = texts()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op3_pii"](spark, str(tmp_path)).collect():
        spans = plain(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]


def test_words_nearby_decide(spark):
    iban, number = "GB82 WEST 1234 5698 7654 32", "123-45-6789"
    rows = [f"pay {iban} now", f"sample {iban}", f"bank account {iban} (test)", f"ssn {number}", f"ssn {number} of order 5", f"see {number}", "version 1.2.3.4", "server 1.2.3.4"]
    found = pii.with_spans(frame(spark, rows)).select("doc_id", pii.listed("spans", pii.BASE + pii.MORE).alias("s"), pii.scored("spans", pii.BASE + pii.MORE).alias("n")).collect()
    got = {r.doc_id: [(s.split(":")[0], int(n)) for s, n in zip(r.s.split(","), r.n.split(","), strict=True) if s] for r in found}
    assert got == {0: [("iban", 70)], 1: [], 2: [("iban", 50)], 3: [("national_id", 70)], 4: [], 5: [], 6: [("ip", 30)], 7: [("ip", 90)]}


def test_fifty_thousand_matches_in_a_text(spark):
    """Time in proportion to the matches: 50,000 addresses took minutes when arrays grew one by one."""
    text = "é " + "ab@c.de, " * 50_000 + "x" * 3000
    docs = frame(spark, [text])
    start = time.monotonic()
    (row,) = pii.with_spans(docs).select(pii.listed("spans", pii.BASE).alias("s")).collect()
    assert row.s == ",".join(f"email:{2 + 9 * i}:{9 + 9 * i}" for i in range(50_000))
    (row,) = pii.redact(docs).collect()
    assert row.text == text.replace("ab@c.de", "[EMAIL]")
    assert time.monotonic() - start < 60


def test_running(spark):
    docs = spark.createDataFrame([([i % 7 for i in range(n)],) for n in (0, 1, 63, 64, 65, 4096, 4097, 5000)], "a array<int>")
    for r in docs.select("a", pii.running(F.col("a"), lambda a, b: a + b).alias("sum"), pii.running(F.col("a"), F.greatest).alias("max")).collect():
        assert r["sum"] == list(accumulate(r.a)) and r["max"] == list(accumulate(r.a, max))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("a@b.cc", 1, 2, 3), ("none", 4, 5, 6)], "text string, spans int, reach int, pieces int")
    assert pii.redact(docs).collect() == [("[EMAIL]", 1, 2, 3), ("none", 4, 5, 6)]
    assert pii.with_spans(docs).columns == ["text", "reach", "pieces", "spans"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.with_spans(docs).collect() == [] and pii.redact(docs).collect() == []
