"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. All in Spark SQL functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import fresh

SPAN = "array<struct<start:int,stop:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` finds the leftmost non-overlapping proposals; ``needle`` is a
    character that any proposal has; ``valid`` tells whether a proposal stands;
    ``score`` is what it then scores, ``lift`` what a word of ``context`` near
    it adds, ``fall`` what a word of ``against`` near it takes away. Spans under
    the threshold go, unless the kind ``stands`` whatever it scores.
    """

    name: str
    pattern: str
    needle: str
    valid: Callable[[Column], Column]
    score: float
    context: str = ""
    lift: float = 0.0
    against: str = ""
    fall: float = 0.0
    stands: bool = False


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn check."""
    return F.call_function("luhn_check", digits(text))


def mod97(text: Column) -> Column:
    """Whether an IBAN's letters and digits, its first four moved to the end, give 1 modulo 97."""
    plain = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "(?!^)(?!$)")
    worth = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + worth(c)) % 97) == 1


def _parts_fit(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _digits_between(least: int, most: int):
    return lambda text: F.length(digits(text)).between(least, most)


# Patterns that find what the plain ones of each kind find, without their retries: a run of
# characters that can't match is passed over once, whole (possessive), not once from each character.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

#: The base kinds always stand; the others need their checksum or words nearby, and may fall by such words.
BASE = (
    Kind("email", EMAIL, "@", lambda t: F.lit(True), 0.9, r"\b(?:mail|email|contact|write)\b", 0.1, r"\b(?:example|sample|test)\b", 0.3, True),
    Kind("ip", IP, ".", _parts_fit, 0.7, r"\b(?:ip|address|host|server)\b", 0.2, r"\b(?:version|release|build)\b", 0.4, True),
    Kind("card", CARD, "", lambda t: _digits_between(13, 19)(t) & luhn(t), 0.8, r"\b(?:card|visa|credit|debit|payment)\b", 0.2, r"\b(?:example|sample|test)\b", 0.4, True),
    Kind("phone", PHONE, "+", _digits_between(9, 15), 0.7, r"\b(?:phone|call|tel|mobile|fax)\b", 0.2, stands=True),
)
MORE = (
    Kind("iban", IBAN, "", mod97, 0.7, r"\b(?:iban|bank|account|transfer)\b", 0.2, r"\b(?:example|sample|dummy|test)\b", 0.4),
    Kind("national_id", NATIONAL_ID, "-", lambda t: ~t.rlike("^(?:000|666|9)") & ~t.rlike("-00-|-0000$"), 0.3, r"\b(?:ssn|social security|national id|tax id)\b", 0.4, r"\b(?:part|serial|order|invoice|example|sample)\b", 0.3),
)
THRESHOLD = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3, block: int = 64) -> Column:
    """``join`` of each of an array's whole numbers (0 or more) with all before it: running sums or maxima.

    In blocks, and blocks of blocks, as arrays grow by copying: so the work is
    in proportion to the array until it has some millions of numbers.
    """
    none = F.array().cast("array<int>")
    scan = lambda a: F.aggregate(a, none, lambda acc, n: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), n))))
    if levels == 1:
        return scan(values)

    def blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / block).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: scan(F.slice(a, i * block + 1, F.lit(block))))).otherwise(F.array().cast("array<array<int>>"))

    def joined(parts: Column) -> Column:
        lasts = running(F.transform(parts, lambda p: F.element_at(p, -1)), join, levels - 1, block)
        return let(lasts, lambda up: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda n: join(F.coalesce(F.get(up, i - 1), F.lit(0)), n)))))

    return let(values, lambda a: let(blocks(a), joined))


def _spans(found: Column, between: Column, ends: Column, kind: Kind, near: int) -> Column:
    """The standing spans of one kind, by start, from its proposals, the texts between them and their ends."""

    def span(match: Column, i: Column) -> Column:
        stop, score = F.get(ends, i), F.lit(kind.score)
        around = F.lower(F.concat(F.right(F.get(between, i), F.lit(near)), F.lit(" "), F.left(F.get(between, i + 1), F.lit(near))))
        if kind.context:
            score = score + F.when(around.rlike(kind.context), kind.lift).otherwise(0.0)
        if kind.against:
            score = score - F.when(around.rlike(kind.against), kind.fall).otherwise(0.0)
        return F.struct((stop - F.length(match)).alias("start"), stop.alias("stop"), F.lit(kind.name).alias("kind"), F.round(score, 2).alias("score"), kind.valid(match).alias("valid"))

    standing = F.filter(F.transform(found, span), lambda s: s["valid"] & (F.lit(kind.stands) | (s["score"] >= THRESHOLD)))
    return F.transform(standing, lambda s: s.dropFields("valid")).cast(SPAN)


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "spans", kinds: tuple[Kind, ...] = BASE + MORE, near: int = 40) -> DataFrame:
    """All columns of ``docs`` and ``name``: for each kind its spans (start, stop, kind, score) in code points.

    ``name`` is a struct with an array for each kind, ordered by start; the end
    is exclusive. Words within ``near`` characters of a span, up to the spans
    beside it, count as nearby. A null or empty text has no spans. A column
    ``name`` is replaced; repeated rows stay repeated; an empty table stays empty.
    """
    keep, text, empty = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()], F.col(f"`{text_col}`"), F.array().cast("array<string>")
    col = {(k.name, what): fresh(docs, f"{what}_{k.name}") for k in kinds for what in ("found", "between", "ends")}

    def found(k: Kind) -> Column:
        matches = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        return F.coalesce(F.when(F.contains(text, F.lit(k.needle)), matches) if k.needle else matches, empty)

    def between(k: Kind) -> Column:
        return F.when(F.size(col[k.name, "found"]) > 0, F.split(text, k.pattern, -1)).otherwise(empty)

    def ends(k: Kind) -> Column:
        steps = F.zip_with(col[k.name, "found"], F.slice(col[k.name, "between"], 1, F.size(col[k.name, "found"])), lambda m, gap: F.length(m) + F.length(gap))
        return running(steps, lambda a, b: a + b)

    # one step after another, so that each scan of a text is made once
    staged = docs.select(*keep, *(found(k).alias(col[k.name, "found"]) for k in kinds))
    staged = staged.select("*", *(between(k).alias(col[k.name, "between"]) for k in kinds))
    staged = staged.select("*", *(ends(k).alias(col[k.name, "ends"]) for k in kinds))
    parts = (_spans(*(F.col(col[k.name, what]) for what in ("found", "between", "ends")), k, near).alias(k.name) for k in kinds)
    return staged.select(*keep, F.struct(*parts).alias(name))


def listed(spans: str, kinds: tuple[Kind, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed and then by start, comma-joined."""
    return F.concat_ws(",", *(F.transform(F.col(f"{spans}.{k.name}"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])) for k in kinds))


def scored(spans: str, kinds: tuple[Kind, ...]) -> Column:
    """The scores of all spans in hundredths, in the order of ``listed``."""
    return F.concat_ws(",", *(F.transform(F.col(f"{spans}.{k.name}"), lambda s: F.round(s["score"] * 100).cast("int").cast("string")) for k in kinds))


#: A text is cut into pieces of so many characters, as finding a place in it means counting up to there.
PIECE = 1024


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets, as ``[EMAIL]``.

    Spans that overlap become one, named for the first. Texts without spans,
    null ones included, and all other columns stay as they are. Repeated rows
    stay repeated; an empty table stays empty.
    """
    text, spans, every, reach, pieces = F.col(f"`{text_col}`"), *(fresh(docs, n) for n in ("spans", "every", "reach", "pieces"))
    marked = with_spans(docs, text_col, spans, kinds)
    marked = marked.withColumn(every, F.array_sort(F.concat(*(F.col(f"{spans}.{k.name}") for k in kinds)))).drop(spans)
    # how far the spans up to each one reach: one that starts beyond the reach of those before it begins a new span
    marked = marked.withColumn(reach, running(F.transform(every, lambda s: s["stop"]), F.greatest))
    marked = marked.withColumn(pieces, F.when(F.size(every) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def cut(held: Column, low: Column, high: Column) -> Column:
        """Characters from ``low`` up to ``high`` of a text in pieces."""
        a, b = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        part = lambda i: F.coalesce(F.get(held, i), F.lit(""))
        inside = F.substring(part(a), low % PIECE + 1, high - low)
        across = F.concat(F.substring(part(a), low % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(held, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.left(part(b), high % PIECE))
        return F.when(a == b, inside).otherwise(across)

    def clean(held: Column, far: Column, all_: Column) -> Column:
        before = lambda i: F.coalesce(F.get(far, i - 1), F.lit(0))
        heads = F.filter(F.transform(all_, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("from"))), lambda s: s["start"] >= s["from"])
        body = F.transform(heads, lambda s: F.concat(cut(held, s["from"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(body, ""), cut(held, F.element_at(far, -1), F.size(held) * PIECE))

    told = let(F.col(pieces), lambda held: let(F.col(reach), lambda far: let(F.col(every), lambda all_: clean(held, far, all_))))
    return marked.withColumn(text_col, F.when(F.size(every) > 0, told).otherwise(text)).select(*docs.columns)
