"""Personal data (operator 6): patterns propose spans, checksums confirm, context adjusts the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import run_start, spans_of

LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"{run_start(LOCAL)}[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = rf"{run_start('0-9')}[0-9]++(?:\.[0-9]++){{3}}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0).cast("long"), step) == 1


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_card(found: Column) -> Column:
    return F.when(F.length(_digits(found)).between(16, 19), luhn(_digits(found))).otherwise(False)


def _is_ip(found: Column) -> Column:
    # at most 255, without leading zeros that a long run of digits may have
    return F.forall(F.split(found, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


@dataclass(frozen=True)
class PiiKind:
    """``score`` is that of a confirmed match; context words near it add ``boost``. Base kinds are kept at any score."""

    kind: str
    pattern: str
    confirm: object = None
    score: float = 0.6
    words: str = ""
    boost: float = 0.3
    base: bool = True

    def spans(self, text: Column) -> Column:
        found = spans_of(text, self.pattern)
        if self.confirm:
            found = F.filter(found, lambda s: self.confirm(s["found"]))
        near = lambda s: F.concat_ws(" ", s["before"], s["after"]).rlike(rf"(?i)(?<!\pL)(?:{self.words})(?!\pL)")
        score = lambda s: F.lit(self.score) + F.when(near(s), self.boost).otherwise(0.0) if self.words else F.lit(self.score)
        return F.transform(found, lambda s: F.struct(F.lit(self.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), score(s).alias("score")))


#: In the order in which kinds are listed.
KINDS = (
    PiiKind("email", EMAIL, score=0.9, words="e-?mail|mail|contact|correo|kontakt"),
    PiiKind("ip", IP, _is_ip, score=0.6, words="ip|host|server|address|serveur|servidor"),
    PiiKind("card", CARD, _is_card, score=0.8, words="card|visa|mastercard|carte|tarjeta|karte"),
    PiiKind("phone", PHONE, lambda f: F.length(_digits(f)).between(8, 15), score=0.7, words="call|phone|tel|mobile|telefon|llame|appelez"),
    PiiKind("iban", IBAN, lambda f: mod97(F.replace(f, F.lit(" "), F.lit(""))), score=0.8, words="iban|account|bank|konto|compte|cuenta", base=False),
    PiiKind("national_id", NATIONAL_ID, score=0.3, words="ssn|social security|national id|identity", base=False),
)
#: Spans of kinds that aren't base need this score.
LEAST_SCORE = 0.5


def find_pii(documents: DataFrame, kinds: tuple[PiiKind, ...] = KINDS, least_score: float = LEAST_SCORE, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds the array column ``into``: ``kind, start, end, found, score`` by kind as listed, then start.

    A row-wise projection: no shuffle, rows and other columns stay as they are (``into`` is replaced). Spans are
    counted in code points of the whole text. A null or empty text has none. Spans of different kinds may overlap.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = [k.spans(value) if k.base else F.filter(k.spans(value), lambda s: s["score"] >= least_score) for k in kinds]
    return documents.withColumn(into, F.concat(*found))


#: Code points of the blocks that a text is cut into to be put together again, and spans that are merged at once.
BLOCK = 512
CHUNK = 256
_SPAN = "struct<start:int,end:int,kind:string>"


def _merged(spans: Column) -> Column:
    """Sorted spans as disjoint ones, each named after its first part; chunked, so that growing arrays stay short."""
    none = F.array().cast(f"array<{_SPAN}>")

    def one(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = F.struct(s.alias("last"), F.when(last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last)).alias("done"))
        return F.when(s["start"] < last["end"], F.struct(joined.alias("last"), acc["done"].alias("done"))).otherwise(apart)

    def chunk(acc: Column, first: Column, all_of: Column) -> Column:
        step = F.aggregate(F.slice(all_of, first, CHUNK), F.struct(acc["last"].alias("last"), none.alias("done")), one)
        # bound to a variable, as an expression used twice in a lambda would run twice
        return F.get(F.transform(F.array(step), lambda s: F.struct(s["last"].alias("last"), F.array_append(acc["chunks"], s["done"]).alias("chunks"))), F.lit(0))

    def all_chunks(all_of: Column) -> Column:
        start = F.struct(F.lit(None).cast(_SPAN).alias("last"), F.array().cast(f"array<array<{_SPAN}>>").alias("chunks"))
        done = F.aggregate(F.sequence(F.lit(1), F.size(all_of), F.lit(CHUNK)), start, lambda acc, first: chunk(acc, first, all_of))
        return F.get(F.transform(F.array(done), lambda d: F.array_append(F.flatten(d["chunks"]), d["last"])), F.lit(0))

    return F.get(F.transform(F.array(spans), all_chunks), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in blocks, without a walk from the text's head."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda at: F.coalesce(F.get(blocks, at), F.lit(""))
    inner = F.substring(block(i), start % BLOCK + 1, end - start)
    across = F.concat(F.substring(block(i), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.left(block(j), end % BLOCK))
    return F.when(i == j, inner).otherwise(across)


def redact(documents: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replaces each span by its kind in angle brackets; overlapping spans become one, named after the first.

    A null text stays null; texts without spans stay as they are. Time follows the text's length and its spans: both are
    gone through once, the text in blocks.
    """
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def put_together(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["spans"], i - 1)["end"]).otherwise(0)
            return F.concat(_between(x["blocks"], before, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))

        last = F.get(x["spans"], F.size(x["spans"]) - 1)["end"]
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), _between(x["blocks"], last, x["size"]))

    clean = F.get(F.transform(F.array(F.struct(blocks.alias("blocks"), _merged(ordered).alias("spans"), F.char_length(text).alias("size"))), put_together), F.lit(0))
    return documents.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text)))
