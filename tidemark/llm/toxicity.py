"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import discard, sliced, stored, strings

#: Slots of the evidence table; features meet in one if their hashes do.
SLOTS = 1 << 20
#: Bytes of a word's beginnings and endings that are features, besides the whole word.
STARTS, ENDS = (3, 4, 5, 6, 7, 8), (3, 4, 5)
KINDS = 1 + len(STARTS) + len(ENDS)
#: Words of a block of the chain, and of a part whose matrices are held at a time.
BLOCK, PART = 64, 1 << 18
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Evidence beyond this counts as this; it is drawn to 0 as by so many documents.
MOST, PRIOR = 6.0, 4.0
#: Log odds beyond this count as this.
REACH = 20.0
_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Letters of words: a-z, A-Z and all bytes of characters beyond ASCII.
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def pieces(data: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end between words."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and _LETTER[data[end]]:
            end += 1
        yield at, end
        at = end


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: maximal runs of letters."""
    letter = np.concatenate([[False], _LETTER[data], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    return edge[::2], edge[1::2]


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Slots of each word's features: the word, its beginnings and its endings; -1 where the word is too short to have one.

    With sums of byte times power, the hash of any part of the text is a
    difference of two of them, brought to the same power.
    """
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _PRIME)]))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _INVERSE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    size, out = end - begin, np.full((KINDS, len(begin)), -1, np.int32)

    def put(kind: int, a: np.ndarray, b: np.ndarray, which: np.ndarray | slice) -> None:
        h = (sums[b] - sums[a]) * down[a] + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[kind, which] = (h >> np.uint64(44)).astype(np.int32)

    put(0, begin, end, slice(None))
    for i, n in enumerate(STARTS):
        long = np.flatnonzero(size > n)
        put(1 + i, begin[long], begin[long] + n, long)
    for i, n in enumerate(ENDS):
        long = np.flatnonzero(size > n)
        put(1 + len(STARTS) + i, end[long] - n, end[long], long)
    return out


@dataclass(frozen=True)
class Evidence:
    """For each slot, how many toxic and how many clean labelled documents have its features; and how many there are."""

    toxic: np.ndarray
    clean: np.ndarray
    totals: tuple[int, int]

    @cached_property
    def share(self) -> float:
        return (self.totals[0] + 1) / (sum(self.totals) + 2)

    def odds(self, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """Log odds of toxic against clean, drawn towards 0 for few documents."""
        p = self.share
        return np.clip(np.log((toxic + PRIOR * p) / (clean + PRIOR * (1 - p))) - np.log(p / (1 - p)), -MOST, MOST).astype(np.float32)

    @cached_property
    def table(self) -> np.ndarray:
        return np.append(self.odds(self.toxic, self.clean), np.float32(0))

    def of(self, slots: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Evidence of features. ``own``: the label of the counted document that each word is from, which doesn't count for itself."""
        if own is None:
            return self.table[slots]
        odds = self.odds(np.maximum(self.toxic[slots] - (own == 1), 0), np.maximum(self.clean[slots] - (own == 0), 0))
        return np.where(slots < 0, np.float32(0), odds)


def _entering(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The vector before each of ``steps`` (2x2 matrices), from ``start`` on, each scaled to sum 1: block products, the same again over blocks, then within them."""
    n = len(steps)
    out = np.empty((n, 2))
    if n <= BLOCK:
        for i in range(n):
            out[i] = start
            start = start @ steps[i]
            start = start / start.sum()
        return out
    blocks = -(-n // BLOCK)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (blocks * BLOCK - n, 2, 2))])
    # by place in the block, then by entry: each operation runs over all blocks' numbers in a row
    at = np.ascontiguousarray(padded.reshape(blocks, BLOCK, 4).transpose(1, 2, 0))
    a, b, c, d = at[0]
    for p, q, r, s in at[1:]:
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        most = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / most, b / most, c / most, d / most
    x, y = _entering(np.stack([a, b, c, d], axis=1).reshape(-1, 2, 2), start).T
    within = np.empty((BLOCK, 2, blocks))
    for i, (p, q, r, s) in enumerate(at):
        within[i] = x, y
        x, y = x * p + y * r, x * q + y * s
        both = x + y
        x, y = x / both, y / both
    return within.transpose(2, 0, 1).reshape(-1, 2)[:n]


@dataclass(frozen=True)
class Field:
    """A chain of two tags, 0 and 1: ``bias`` and ``weights`` (of the strongest evidence, then of each kind) for tag 1, ``change`` for each pair of tags; ``scale`` makes scores of log odds."""

    bias: float = -3.0
    weights: tuple[float, ...] = (1.0,) + (0.0,) * KINDS
    change: tuple[tuple[float, float], ...] = ((0.0, 0.0), (0.0, 0.0))
    scale: tuple[float, float] = (0.0, 1.0)

    def emission(self, evidence: np.ndarray) -> np.ndarray:
        """Score of tag 1 over tag 0 of each word."""
        weights = np.array(self.weights, np.float32)
        return (self.bias + weights[0] * evidence.max(axis=0, initial=-MOST) + weights[1:] @ evidence).astype(np.float64)

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: log odds of tag 1 of each word, and expected numbers of each pair of tags.

        All documents are one chain, which each document's ``first`` word begins
        anew: its matrix has equal rows, so nothing passes it in either direction.
        """
        n, change = len(emission), np.exp(np.array(self.change))
        forward, backward, pairs = np.empty(n), np.empty(n), np.zeros((2, 2))

        def steps(a: int, b: int) -> np.ndarray:
            x, new = np.exp(np.clip(emission[a:b], -60, 60)), first[a:b]
            out = np.empty((b - a, 2, 2))
            out[..., 0] = np.where(new[:, None], 1.0, change[:, 0])
            out[..., 1] = np.where(new[:, None], 1.0, change[:, 1]) * x[:, None]
            return out

        parts = [(a, min(a + PART, n)) for a in range(0, n, PART)]
        now = np.array([0.5, 0.5])
        for a, b in parts:
            m = steps(a, b)
            enter = _entering(m, now)
            after = enter[:, :1] * m[:, 0] + enter[:, 1:] * m[:, 1]
            forward[a:b] = np.log(after[:, 1]) - np.log(after[:, 0])
            now = after[-1] / after[-1].sum()
        now = np.array([0.5, 0.5])
        for a, b in reversed(parts):
            m = steps(a, b)
            leave = _entering(m[::-1].transpose(0, 2, 1), now)[::-1]
            backward[a:b] = np.log(leave[:, 1]) - np.log(leave[:, 0])
            now = m[0] @ leave[0]
            now = now / now.sum()
            p = 1 / (1 + np.exp(-np.concatenate([forward[a - 1 : a] if a else np.zeros(1), forward[a : b - 1]])))
            both = np.stack([1 - p, p], axis=1)[:, :, None] * m * leave[:, None, :]
            both = both[~first[a:b]]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return forward + backward, pairs

    def score(self, strongest: np.ndarray) -> np.ndarray:
        """Scores of documents from their strongest word's log odds."""
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * np.clip(strongest, -REACH, REACH), -40, 40)))


@dataclass
class Read:
    """Words of some texts: where they are in ``data`` (all lower-cased texts, each with a blank behind), and which text each is from."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    values: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.diff(self.text, prepend=-1) != 0


def read(texts: list[str], evidence: Evidence, field: Field | None = None, labels: list[int] | None = None) -> Read:
    """Words with their emission under ``field`` or, without one, their evidence by kind; made piece by piece, so that of a long text only words are held."""
    coded = [lowered(t).encode() + b" " for t in texts]
    data, offsets = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    begins, ends, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((KINDS, 0), np.float32) if field is None else np.empty(0)]
    for a, b in pieces(data):
        begin, end = words(data[a:b])
        own = None if labels is None else np.array(labels)[np.searchsorted(offsets, begin + a, "right") - 1]
        found = evidence.of(features(data[a:b], begin, end), own)
        values.append(found if field is None else field.emission(found))
        begins.append(begin + a)
        ends.append(end + a)
    begin = np.concatenate(begins)
    return Read(data, offsets, begin, np.concatenate(ends), np.searchsorted(offsets, begin, "right") - 1, np.concatenate(values, axis=-1))


def strongest(odds: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The highest log odds of each text; of one without words, less than any."""
    out = np.full(n, -REACH)
    np.maximum.at(out, text, odds)
    return out


@dataclass(frozen=True)
class Model:
    evidence: Evidence
    field: Field

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores of whole texts, and their spans: runs of words with tag 1, by code points (end exclusive), with the highest marginal of each."""
        r = read(texts, self.evidence, self.field)
        odds, _ = self.field.marginals(r.values, r.first)
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hit = np.flatnonzero(odds >= 0)
        for run in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(r.text[hit]) > 0)) + 1) if len(hit) else []:
            i = int(r.text[run[0]])
            spans[i].append((int(r.begin[run[0]]), int(r.end[run[-1]]), float(1 / (1 + np.exp(-odds[run].max())))))
        for i, found in enumerate(spans):
            if found:
                at = np.concatenate([[0], np.cumsum(r.data[r.offsets[i] : r.offsets[i + 1]] & 0xC0 != 0x80)])
                spans[i] = [(int(at[a - r.offsets[i]]), int(at[b - r.offsets[i]]), p) for a, b, p in found]
        return self.field.score(strongest(odds, r.text, len(texts))), spans


def counted(labelled: DataFrame) -> Evidence:
    """Evidence from all rows (``text``, ``toxic``): slots are counted in the tasks and summed by a shuffle; two sums for each slot at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS), np.int32)
        for b in sliced(batches, 16):
            for t, y in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True):
                data, seen = np.frombuffer(lowered(t).encode(), np.uint8), np.empty(0, np.int32)
                for at, end in pieces(data):
                    seen = np.union1d(seen, features(data[at:end], *words(data[at:end])))
                sums[y, seen[seen >= 0]] += 1
        for y in (0, 1):
            slots = np.flatnonzero(sums[y])
            for part in np.array_split(slots, -(-len(slots) // 16384)) if len(slots) else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), y, np.int32)), pa.array(part.astype(np.int32)), pa.array(sums[y, part].astype(np.int64))], names=["y", "slot", "n"])

    rows = labelled.select("text", "toxic")
    sums = rows.mapInArrow(count, "y int, slot int, n long").groupBy("y", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, SLOTS), np.int32)
    table[sums["y"].to_numpy(), sums["slot"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 1 << 30)
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    return Evidence(table[1], table[0], (totals.get(1, 0), totals.get(0, 0)))


def learned(texts: list[str], labels: list[int], evidence: Evidence, steps: int = 30, rounds: int = 2) -> Field:
    """Fit a field to labelled documents that ``evidence`` has counted.

    Words of toxic documents are labelled by their evidence: those whose
    strongest is 2 or more, and each document's strongest; in the next of the
    ``rounds`` those that the field itself tags. All words of clean documents are
    0. ``steps`` of Adam raise the likelihood of these tags; then a logistic line
    from a document's strongest log odds to its label makes scores.
    """
    y = np.array(labels, np.int64)
    r = read(texts, evidence, labels=labels)
    if not y.any() or y.all() or not len(r.text):
        return Field(bias=-30.0, scale=(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0))
    peak = r.values.max(axis=0)
    inputs = np.concatenate([np.ones((1, len(peak)), np.float32), peak[None], r.values])
    tags = (y[r.text] == 1) & (peak >= np.minimum(2.0, strongest(peak, r.text, len(y)))[r.text])
    field = Field()
    for nth in range(rounds):
        field = _ascent(field, inputs, tags, r.first, steps)
        odds, _ = field.marginals(field.emission(r.values), r.first)
        best = strongest(odds, r.text, len(y))
        tags = (y[r.text] == 1) & (odds >= np.minimum(0.0, best)[r.text])
    return Field(field.bias, field.weights, field.change, _line(best, y, evidence.share))


def _ascent(field: Field, inputs: np.ndarray, tags: np.ndarray, first: np.ndarray, steps: int) -> Field:
    """Adam on the log-likelihood of ``tags``, for each toxic word, with a little pull towards 0."""
    follows = np.flatnonzero(~first)
    observed = np.bincount(2 * tags[follows - 1].astype(int) + tags[follows], minlength=4).reshape(2, 2)
    theta = np.concatenate([[field.bias], field.weights, np.ravel(field.change)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    make = lambda t: Field(float(t[0]), tuple(t[1:-4].tolist()), tuple(map(tuple, t[-4:].reshape(2, 2).tolist())))
    for k in range(1, steps + 1):
        now = make(theta)
        odds, pairs = now.marginals(theta[:-4].astype(np.float32) @ inputs, first)
        away = (tags - 1 / (1 + np.exp(-np.clip(odds, -60, 60)))).astype(np.float32)
        grad = np.concatenate([inputs @ away, (observed - pairs).ravel()]) / max(1, tags.sum()) - 1e-2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
    return make(theta)


def _line(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression of labels on one number; toxic ones have ``share`` of the weight."""
    x = np.clip(x, -REACH, REACH)
    weight = len(y) * np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        r, w = weight * (y - p), weight * p * (1 - p)
        h = np.array([[w.sum() + 0.1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, [r.sum() - 0.1 * a, (r * x).sum() - 0.1 * (b - 1)])
        a, b = a + float(np.clip(step[0], -1, 1)), max(0.05, b + float(np.clip(step[1], -1, 1)))
    return a, b


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", sample_rows: int = 1200, longest: int = 200_000) -> Model:
    """Learn from labelled documents: evidence from all of them, the field from a bounded sample.

    Rows with a null label are left out, null texts are empty, labels other than
    0 count as 1. The field, a dozen numbers, is fitted on about ``sample_rows``
    documents of up to ``longest`` characters, as many toxic as clean ones where
    there are enough, chosen by a hash of all that a row holds; those come to the
    driver, and never more than twice as many. An empty table gives a model that
    tags nothing.
    """
    label = (F.col(label_col) != 0).cast("int")
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.coalesce(text_col, F.lit("")).alias("text"), label.alias("toxic"), F.xxhash64(*labelled.columns).alias("h"))
    rows = stored(rows, "labelled")
    evidence = counted(rows)
    some = rows.where(F.length("text") <= longest)
    share = {y: min(1.0, sample_rows / 2 / max(1, n)) for y, n in zip((1, 0), evidence.totals, strict=True)}
    picked = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    # copies of a row have one hash: the limit holds where they are many
    sample = some.where(picked).limit(2 * sample_rows).select("text", "toxic", "h").toArrow().sort_by([("h", "ascending")])
    field = learned(sample["text"].to_pylist(), sample["toxic"].to_pylist(), evidence)
    discard(rows)
    return Model(evidence, field)


SPANS = "array<struct<start: int, end: int, marginal: double>>"


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``score`` (0 to 1), ``predicted`` (1 from 0.5 on), ``spans`` of the whole text (code points, end exclusive).

    Null texts are empty; a text without words has the least score. Repeated
    rows stay repeated, columns of these names are replaced, an empty table
    stays empty.
    """
    docs = docs.drop("score", "predicted", "spans")
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = strings(b.column(at))
            scores, spans, start = [], [], 0
            while start < len(texts):  # texts of about a piece together
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size + len(texts[end]) <= PIECE:
                    size += len(texts[end])
                    end += 1
                s, found = sent.value.tag(texts[start:end])
                scores.append(s)
                spans += [[dict(zip(("start", "end", "marginal"), x, strict=True)) for x in f] for f in found]
                start = end
            score = np.concatenate(scores)
            more = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "score", "predicted", "spans"])

    more = (F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.from_json(F.lit("[]"), SPANS).alias("spans"))
    return docs.mapInArrow(run, docs.select("*", *more).schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_rows: int = 1_000_000, sample_rows: int = 1200) -> DataFrame:
    """Learn from labelled documents outside the held-out fold; score every document.

    About ``label_rows`` labels at most are learned from, chosen by a hash of
    their id where there are more: so they can be sent to the documents, and no
    text is shuffled.

    One row per document: ``id_col``, ``held_out``, ``score``, ``predicted``,
    ``n_spans`` and ``spans`` (``start:end`` by code points, comma-joined). An id
    with several labels is toxic if one says so; null ids have no label and belong
    to the fold of the empty text.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).groupBy("id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = stored(known.where(F.col("toxic").isNotNull() & ~held_out("id")), "labels")
    if (n := known.count()) > label_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(label_rows / n * (1 << 30)))
    model = fit(slim.join(F.broadcast(known), "id"), "text", "toxic", sample_rows)
    out = with_toxicity(slim.select("id", held_out("id").alias("held_out"), "text"), model)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"))
