"""Text of queries and labels of segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_query(query: Column) -> Column:
    """Lower case, ``ё`` as ``е``, runs of any Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(query), "ё", "е"), r"(?U)\s+", " "))


def word_count(clean: Column) -> Column:
    """Words of a normalized query; 0 for null or empty."""
    return F.when(clean.isNull() | (clean == ""), 0).otherwise(F.size(F.split(clean, " ")))


def bool_text(flag: Column) -> Column:
    """``True`` or ``False``."""
    return F.initcap(flag.cast("string"))


def bucket_label(value: Column, edges: list[int]) -> Column:
    """The integer bucket of ``value`` between ``edges``: ``<a``, ``a``, ``a-b`` or ``z+``; null and negative: ``(null)``."""
    label = F.when(value.isNull() | (value < 0), "(null)").when(value < edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        label = label.when(value < high, str(low) if high - low == 1 else f"{low}-{high - 1}")
    return label.otherwise(f"{edges[-1]}+")
