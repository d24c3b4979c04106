"""GIF as a media column: write and read frames, LZW streams, palettes, transparency and disposal."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.util import sliced, strings

MOST_CODES = 4096
#: Pixels that a canvas or a frame to be read may have; a damaged size could ask for gigabytes.
MOST_PIXELS = 1 << 26
#: Sample n is shown as the grey of level n.
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
BINS = 16


@dataclass
class Frame:
    """One picture of a GIF: its rectangle on the screen, samples, and how it is shown.

    ``canvas`` is the whole screen (RGBA) while this frame is shown; readers
    fill it in. ``disposal`` is 0 or 1 to leave the frame, 2 to clear its
    rectangle, 3 to restore what was there before.
    """

    samples: np.ndarray
    left: int = 0
    top: int = 0
    delay_cs: int = 10
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None
    canvas: np.ndarray | None = None


@cache
def _width_table(bits: int) -> np.ndarray:
    known = (1 << bits) + 2 + np.maximum(np.arange(1 << 16) - 1, 0)
    return np.clip(np.frexp(known)[1], bits + 1, 12)


def code_widths(since: int, count: int, bits: int) -> np.ndarray:
    """Bits of ``count`` codes, the first being number ``since`` (from 0) after a clear code."""
    table = _width_table(bits)
    return table[since : since + count] if since + count <= len(table) else np.full(count, 12)


def lzw_codes(data: bytes, bits: int) -> np.ndarray:
    """LZW codes of samples; the table is cleared whenever it is full.

    In the loop a code stands eight bits up, so that with the next sample it
    makes a key of the table.
    """
    clear, table, free, most = 1 << bits, {}, (1 << bits) + 2 << 8, MOST_CODES << 8
    out = [clear << 8]
    if data:
        put, known = out.append, table.get
        at = data[0] << 8
        for c in data[1:]:
            longer = known(at | c)
            if longer:
                at = longer
                continue
            put(at)
            if free < most:
                table[at | c] = free
                free += 256
            else:
                put(clear << 8)
                table, free = {}, clear + 2 << 8
                known = table.get
            at = c << 8
        put(at)
    out.append(clear + 1 << 8)
    return np.array(out, np.int64) >> 8


def pack_codes(codes: np.ndarray, bits: int) -> bytes:
    """Codes as a bit stream, lowest bits first, in the widths that readers expect."""
    values = np.asarray(codes, np.int64)
    starts = np.append(np.flatnonzero(values == 1 << bits), len(values))
    widths = np.concatenate([code_widths(0, 1, bits), *(code_widths(0, int(n), bits) for n in np.diff(starts))])[: len(values)]
    ends = np.cumsum(widths)
    at = ends - widths
    byte, shifted = at >> 3, values << (at & 7)
    size = int(ends[-1]) + 7 >> 3
    # bits of different codes never meet, so their bytes add up
    parts = [np.bincount(byte + i, shifted >> 8 * i & 255, size + 2) for i in range(3)]
    return (parts[0][:size] + parts[1][:size] + parts[2][:size]).astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of codes that no clear code interrupts.

    Entry n of the table is what code n stood for, and one sample more: a piece
    of the samples themselves. So a code's length is one more than that of the
    code it refers to, and each of its samples is one that came before; both
    are followed back to plain samples by doubling the steps.
    """
    back = codes - (clear + 2)
    plain = back < 0
    if (codes[plain] >= clear).any() or (back >= np.arange(len(codes))).any():
        raise ValueError("a code that isn't in the table")
    own = np.arange(len(codes))
    up, length = np.where(plain, own, back), np.where(plain, 0, 1)
    while length[up].any():
        length = length + length[up]
        up = up[up]
    length = length + 1
    starts = np.cumsum(length) - length
    total = int(length.sum())
    source = np.arange(total)
    shift = np.where(plain, 0, starts - starts[np.where(plain, 0, back)])
    source = source - np.repeat(shift, length)
    roots = np.zeros(total, bool)
    roots[starts[plain]] = True
    while not roots[source].all():
        source = source[source]
    samples = np.zeros(total, np.uint8)
    samples[starts[plain]] = codes[plain]
    return samples[source]


def lzw_samples(stream: bytes, bits: int, count: int) -> bytes:
    """The first ``count`` samples of a code stream.

    The width of a code depends only on how many came since the table was
    cleared, so a run of codes is cut out of the stream at once.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, since, run, out, made = 8 * len(stream), 0, 0, [], [], 0
    while made < count:
        widths = code_widths(since, min(MOST_CODES, (total - at) // (bits + 1) + 1), bits)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        from_ = ends[:n] - widths[:n]
        byte = from_ >> 3
        values = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (from_ & 7) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((values == clear) | (values == end))
        cut = int(stops[0]) if len(stops) else n
        run.append(values[:cut])
        since += cut
        if cut == n and n:
            at = int(ends[n - 1])
            continue
        out.append(_expand(np.concatenate(run), clear))
        made += len(out[-1])
        if not n or values[cut] == end:
            break
        at, since, run = int(ends[cut]), 0, []
    if made < count:
        raise ValueError("the code stream ends early")
    return np.concatenate(out)[:count].tobytes() if out else b""


def write_gif(frames: list[Frame], width: int, height: int, palette: np.ndarray = GREYS) -> bytes:
    """A GIF of 8-bit frames with one palette of 256 colours, and each frame's own if it has one."""
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.tobytes()]
    for f in frames:
        shown = f.disposal << 2 | (f.transparent is not None)
        rows, cols = f.samples.shape
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, shown, f.delay_cs, f.transparent or 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, cols, rows, 0 if f.palette is None else 0x87))
        if f.palette is not None:
            parts.append(f.palette.tobytes())
        stream = pack_codes(lzw_codes(f.samples.tobytes(), 8), 8)
        parts.append(b"\x08")
        for at in range(0, len(stream), 255):
            block = stream[at : at + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> list[Frame]:
    """All frames with their canvases; a stream that breaks off or isn't a GIF raises ``ValueError``."""
    return list(each_frame(data))


def each_frame(data: bytes) -> Iterator[Frame]:
    """As ``read_gif``, one frame after another."""
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n

    if packed & 0x80:
        common, at = colours(packed, at)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width), "<u4")
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body, at = _blocks(data, at)
            if label == 0xF9:
                flags, delay, key = struct.unpack_from("<BHB", body)
                disposal, transparent = flags >> 2 & 7, key if flags & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, cols, rows, flags = struct.unpack_from("<HHHHB", data, at)
        at, palette = at + 9, common
        if flags & 0x80:
            palette, at = colours(flags, at)
        bits, at = data[at], at + 1
        if not 2 <= bits <= 8 or rows * cols > MOST_PIXELS:
            raise ValueError("no code size or frame size of a GIF")
        stream, at = _blocks(data, at)
        samples = np.frombuffer(lzw_samples(stream, bits, rows * cols), np.uint8).reshape(rows, cols)
        if flags & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, rows, step)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else canvas
        inside = canvas[top : top + rows, left : left + cols]
        part = samples[: inside.shape[0], : inside.shape[1]]
        if palette is None or part.size and int(part.max()) >= len(palette):
            raise ValueError("a sample without a colour")
        colour = np.full((len(palette), 4), 255, np.uint8)
        colour[:, :3] = palette
        shown = colour.view("<u4")[:, 0][part]
        inside[:] = shown if transparent is None else np.where(part == transparent, inside, shown)
        yield Frame(samples, left, top, delay, disposal, transparent, palette, canvas.copy().view(np.uint8).reshape(height, width, 4))
        if disposal == 2:
            inside[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def payload(text: str, block: int = 64) -> bytes:
    """A text as UTF-8, with bytes 0 up to a positive multiple of ``block``."""
    data = text.encode("utf-8")
    return data.ljust(max(block, -(-len(data) // block) * block), b"\0")


def store_text(text: str, width: int = 64, most_rows: int = 4096) -> bytes:
    """A text's payload as a grey GIF, row by row; what exceeds a frame goes to further frames."""
    samples = np.frombuffer(payload(text, width), np.uint8).reshape(-1, width)
    frames = [Frame(samples[y : y + most_rows], disposal=2) for y in range(0, len(samples), most_rows)]
    return write_gif(frames, width, min(len(samples), most_rows))


def with_gif(docs: DataFrame, text_col: str = "text", name: str = "media") -> DataFrame:
    """All columns of ``docs`` and the whole text stored as a GIF; a null text counts as empty.

    Repeated rows stay repeated, a column ``name`` is replaced, an empty table stays empty.
    """
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([store_text(t) for t in strings(b.column(at))], pa.binary())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


FRAMES = "array<struct<left:int,top:int,width:int,height:int,delay_cs:int,histogram:array<bigint>>>"


def with_frames(media: DataFrame, media_col: str = "media", frames_name: str = "frames", samples_name: str = "payload") -> DataFrame:
    """All columns of ``media``, its timed frames, and the red samples of the frames as shown, row by row.

    A frame has its rectangle, delay and a histogram: for each of red, green
    and blue, ``BINS`` counts of its visible pixels. What isn't a whole GIF, or
    is null, has null in both columns. Repeated rows stay repeated, columns of
    these names are replaced, an empty table stays empty.
    """
    media = media.drop(frames_name, samples_name)
    at = media.columns.index(media_col)
    kind = T._parse_datatype_string(FRAMES)
    schema = T.StructType([*media.schema.fields, T.StructField(frames_name, kind), T.StructField(samples_name, T.BinaryType())])

    def described(f: Frame) -> tuple[dict, bytes]:
        shown = f.canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1]]
        solid = shown.reshape(-1, 4) if shown[..., 3].all() else shown[shown[..., 3] > 0]
        histogram = np.concatenate([np.bincount(solid[:, i] >> 4, minlength=BINS) for i in range(3)])
        return {"left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "delay_cs": f.delay_cs, "histogram": histogram.tolist()}, shown[..., 0].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in sliced(batches):
            frames, samples = [], []
            for data in b.column(at).to_pylist():
                try:
                    parts = [described(f) for f in each_frame(data or b"")]
                except ValueError:
                    frames.append(None), samples.append(None)
                    continue
                frames.append([d for d, _ in parts]), samples.append(b"".join(s for _, s in parts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(frames, to_arrow_type(kind)), pa.array(samples, pa.binary())], [*b.schema.names, frames_name, samples_name])

    return media.mapInArrow(run, schema)
