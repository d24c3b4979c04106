import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello, world's   best\n\n text  ", "naïve Ünïcödé 漢字 🎉🏳️‍🌈 \x00\x7f", "<|endoftext|> inside<|endoftext|><|endoftext|>  of \n\n<|endoftext|>\n x <|endoftext", "x" * 3000, "word " * 5000, " \t ", "12345 6'll we've", "one two"]


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces_and_places(spark, size):
    rows = [(i, t, 9, "p") for i, t in enumerate(TEXTS)] + [(None, "one two", None, None), (9, "one two", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, part string").repartition(3)
    out = packing.pack_documents(docs, PATH, max_tokens=size).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = plain_ids(text)
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        want.update((doc, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in out) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in out], size)
    crc = packing.pack_documents(docs, PATH, max_tokens=size, derive=packing.with_crc32).collect()
    assert Counter(r.ids_crc32 for r in crc) == Counter(zlib.crc32(np.array(w[3], "<u4").tobytes()) for w in want.elements())


def check_places(places, size):
    held = defaultdict(list)
    for s, at, n in places:
        held[s].append((at, n))
    for s in held.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= size
    return len(held)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n\t" * 200_000 + "b", "x" * 1_000_000, "é" * 200_000, ("one  two" + " " * 99_999) * 5, "<|endoftext|>" + " " * 150_000 + "<|endoftext|>"], ids=range(7))
def test_very_long_runs(text):
    assert packing.encoder(PATH)(text).tolist() == plain_ids(text)[:-1]


def test_other_vocabularies():
    """A file that is no byte-level BPE is run by its own library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    for text in ("Hello <|endoftext|> World", "a  B\n"):
        assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 2048])
    lengths = [min(size, max(1, int(rng.expovariate(4 / size)))) for _ in range(3000)]
    counts = Counter(lengths)
    places, seen = [], Counter()
    for n, first, pieces, each, sequence, offset in packing.packing_plan(counts, size):
        assert first == seen[n]
        seen[n] += pieces
        places += [(sequence + i // each, offset + i % each * n, n) for i in range(pieces)]
    assert seen == counts
    used = check_places(places, size)
    assert used <= -(-sum(lengths) // size) * 1.01 + 1


def test_plan_is_exact_by_pairs_and_triples():
    for counts in ({6: 1, 4: 1, 5: 1, 3: 1, 2: 1}, {7: 2, 1: 6}):
        assert max(b[4] + b[2] // b[3] for b in packing.packing_plan(counts, 10)) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).collect() == []
