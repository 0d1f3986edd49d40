"""Spans of regular expressions as columns, with built-in functions only.

Patterns are Java's. Texts can be long, so patterns given to :func:`spans_of` should run in linear time: a
repetition that a later part can't follow is possessive, and a match that would start inside a run starts
at the run's head or where the last match ended (``START``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of one text are numbered in chunks of this size, so that growing arrays stay short.
CHUNK = 256
#: Characters of context that a span carries on either side.
CONTEXT = 40

NO_SPANS = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def run_start(chars: str) -> str:
    """At the head of a run of ``chars``, or where the last match ended."""
    return rf"(?:\G|(?<![{chars}]))"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in ``text``, in order.

    An array of ``start, end`` (code points, end exclusive), ``found``, and up to 40 characters ``before`` and
    ``after`` that belong to no other match of the pattern. A null text has no matches.
    """
    pieces = F.split(text, pattern, -1)  # the texts between matches, one more than matches
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        pieces, matches, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size"), m.alias("found"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(p, F.lit(CONTEXT)).alias("head"))
    )

    def one(acc: Column, x: Column, after: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"), x["before"].alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    def chunk(acc: Column, first: Column, all_of: Column) -> Column:
        step = F.aggregate(
            F.sequence(first, F.least(first + CHUNK - 1, F.size(all_of) - 1)),
            F.struct(acc["at"].alias("at"), F.array().cast(NO_SPANS).alias("spans")),
            lambda a, i: one(a, F.get(all_of, i - 1), F.get(all_of, i)["head"]),
        )
        # bound to a variable, as an expression used twice in a lambda would run twice
        return F.element_at(F.transform(F.array(step), lambda s: F.struct(s["at"].alias("at"), F.array_append(acc["chunks"], s["spans"]).alias("chunks"))), 1)

    def number(all_of: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("chunks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(all_of) - 1, F.lit(CHUNK)), start, lambda acc, first: chunk(acc, first, all_of))["chunks"])

    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(pieces), number), 1)).otherwise(F.array().cast(NO_SPANS))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; spans are structs with these fields, in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
