import random
import hashlib
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import gif


def step_by_step(stream, bits, count):
    """A plain LZW reader, one code at a time."""
    value, clear = int.from_bytes(stream, "little"), 1 << bits
    at, width, table, last, out = 0, bits + 1, None, None, b""
    while len(out) < count:
        code = value >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, last, width = [bytes([i]) for i in range(clear)] + [None, None], None, bits + 1
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return out[:count]


@pytest.mark.parametrize("data", [b"\0", b"ab" * 9, b"a" * 100_000, bytes(range(256)) * 40, np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes(), b"the cat sat on the mat " * 3000])
def test_lzw_round_trip(data):
    stream = gif.pack_codes(gif.lzw_codes(data, 8), 8)
    assert gif.lzw_samples(stream, 8, len(data)) == data
    assert step_by_step(stream, 8, len(data)) == data


def test_lzw_without_clearing_and_small_codes():
    codes = [4, 1, 0, 2, 1, 6, 7, 3, 5]
    data = step_by_step(gif.pack_codes(codes, 2), 2, 100)
    assert gif.lzw_samples(gif.pack_codes(codes, 2), 2, len(data)) == data == bytes([1, 0, 2, 1, 1, 0, 0, 2, 3])
    with pytest.raises(ValueError):
        gif.lzw_samples(gif.pack_codes([4, 1, 7, 5], 2), 2, 9)
    with pytest.raises(ValueError):
        gif.lzw_samples(gif.pack_codes([4, 1, 5], 2), 2, 9)


def test_full_table_is_kept_until_cleared():
    """Other writers may go on with a full table; readers must not add to it."""
    rng = np.random.default_rng(2)
    codes = [256, *rng.integers(0, 256, 9000).tolist(), 257]
    stream = gif.pack_codes(codes, 8)
    assert gif.lzw_samples(stream, 8, 9000) == bytes(codes[1:-1]) == step_by_step(stream, 8, 9000)


def test_disposal_transparency_and_delays():
    red = np.zeros((256, 3), np.uint8)
    red[:, 0] = np.arange(256)
    a = gif.Frame(np.full((2, 3), 9, np.uint8), delay_cs=5)
    b = gif.Frame(np.array([[7, 1]], np.uint8), left=1, top=1, delay_cs=6, disposal=2, transparent=1, palette=red)
    c = gif.Frame(np.array([[3]], np.uint8), disposal=3, delay_cs=7)
    d = gif.Frame(np.array([[1]], np.uint8), left=2, delay_cs=8, transparent=1)
    one, two, three, four = gif.read_gif(gif.write_gif([a, b, c, d], 3, 2))
    grey, clear = [9, 9, 9, 255], [0, 0, 0, 0]
    assert one.canvas.tolist() == [[grey] * 3] * 2
    assert two.canvas.tolist() == [[grey] * 3, [grey, [7, 0, 0, 255], grey]]
    assert three.canvas.tolist() == [[[3, 3, 3, 255], grey, grey], [grey, clear, clear]]
    assert four.canvas.tolist() == [[grey] * 3, [grey, clear, clear]]
    assert [f.delay_cs for f in (one, two, three, four)] == [5, 6, 7, 8]


def test_interlaced_rows_and_extensions():
    rows = np.arange(10, dtype=np.uint8)[:, None]
    data = bytearray(gif.write_gif([gif.Frame(rows[[0, 8, 4, 2, 6, 1, 3, 5, 7, 9]])], 1, 10))
    at = 13 + 768
    flags = data.index(b"\x2c", at) + 9
    data[flags] |= 0x40
    data[at:at] = b"\x21\xfe\x03hey\x00" + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    assert gif.read_gif(bytes(data))[0].samples.tolist() == rows.tolist()


def test_broken_files():
    whole = gif.store_text("some text")
    for data in (b"", b"GIF89a", b"PNG" + whole, whole[:-30], whole[:20], whole[:13] + whole[13 + 768 :], struct.pack("<6sHHBBB", b"GIF89a", 1, 1, 0, 0, 0)):
        with pytest.raises(ValueError):
            gif.read_gif(data)


TEXTS = ["", None, "a", "x" * 64, "x" * 65, "naïve 漢字 🎉\x00", "long words here " * 40_000, "x" * 64]


def test_query_round_trip(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    docs = spark.createDataFrame([(i, t, b"no") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in QUERIES["op7_gif"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert r.tail_crc32 == zlib.crc32(want[-64:])
        grey = np.bincount(np.frombuffer(want, np.uint8) >> 4, minlength=16).tolist()
        assert r.feature == f"frames={-(-len(want) // (64 * 4096))};grey={','.join(map(str, grey))}"
        assert (r.media_bytes, r.media_sha256) == (len(gif.store_text(t or "")), hashlib.sha256(gif.store_text(t or "")).hexdigest())


def test_columns_of_bad_media_and_empty_tables(spark):
    media = spark.createDataFrame([(1, None), (2, b"no gif"), (3, gif.store_text("ok"))], "id int, media binary")
    out = {r.id: r for r in gif.with_frames(media).collect()}
    assert out[1].frames is None and out[2].payload is None and out[3].payload.rstrip(b"\0") == b"ok"
    assert gif.with_frames(gif.with_gif(spark.createDataFrame([], "text string"))).collect() == []


def test_damaged_streams_are_null_not_errors(spark):
    """Single bytes changed at random: a damaged GIF reads as something or as null, and no error leaves the reader."""
    rng = random.Random(13)
    whole = gif.store_text("some text, some text, another text " * 20)
    odd = []
    for _ in range(1500):
        own = bytearray(whole)
        own[rng.choice([rng.randrange(len(own)), rng.randrange(13), rng.randrange(781, 801)])] = rng.randrange(256)
        odd.append(bytes(own))
        try:
            gif.read_gif(odd[-1])
        except ValueError:
            pass
    out = gif.with_frames(spark.createDataFrame([(x, 1) for x in odd[:200]], "media binary, frames int")).collect()
    assert len(out) == 200 and all((r.frames is None) == (r.payload is None) for r in out)
