"""Language ID (operator 8): n-gram filters that answer for all languages at once.

A Bloom filter per language, bit-sliced: slot ``i`` of the table holds one bit per language, and the AND of an
n-gram's slots is the mask of all languages whose filter contains it. A text is decided by the number of its
n-grams that each language contains, corrected for the filter's rate of false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, free_name, hash_share, text_chunks

UNKNOWN = "und"
NGRAMS = (2, 3, 4)
#: Labelled documents per language that a fit reads, chosen by a hash of the key; the fit's stated bound.
FIT_PER_LANGUAGE = 1500
#: The most frequent n-grams that each language's filter holds.
PER_FILTER = 3000
SLOTS = 1 << 18
PROBES = 3
#: Characters of a text that are hashed at once.
CHUNK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point, its number if it is a letter, else 32."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of all words of a text, with word edges as blanks; letters only, lower-cased.

    A long text comes in several arrays, cut between words, so that memory follows ``CHUNK`` and the longest word.
    """
    for chunk in text_chunks(text, CHUNK):
        yield _chunk_hashes(chunk)


def _chunk_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters()[raw]
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    found = []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        inner = np.zeros(len(h), dtype=bool)
        for k in range(n):
            part = codes[k : k + len(h)]
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inner |= part == 32
        found.append(h[~inner])  # n-grams within one word
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


@dataclass(frozen=True)
class LanguageFilters:
    """``table[slot]``: a bit per language, 64 to a column. ``false_rate``: of each language's filter."""

    languages: tuple[str, ...]
    table: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes * _MIX) | np.uint64(1)
        for k in range(PROBES):
            yield ((hashes + np.uint64(k) * step) >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = tuple(sorted(grams))
        table = np.zeros((SLOTS, max(1, (len(languages) + 63) // 64)), dtype=np.uint64)
        rate = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            column, bit = table[:, i // 64], np.uint64(1 << (i % 64))
            for at in cls.slots(grams[lang]):
                column[at] |= bit
            rate[i] = float(((column & bit) > 0).mean()) ** PROBES
        return cls(languages, table, rate)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bit masks."""
        first, *more = self.slots(hashes)
        mask = self.table[first]
        for at in more:
            mask &= self.table[at]
        return mask

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and score: the part of the text's n-grams that the language's filter truly holds."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, counts = 0, np.zeros(len(self.languages))
        for hashes in ngram_hashes(text):
            masks = self.masks(hashes)
            total += len(hashes)
            counts += [np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))]
        if not total:
            return UNKNOWN, 0.0
        true = np.clip((counts - total * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(true.argmax())  # of equal languages the first in order
        return self.languages[best], float(min(1.0, true[best] / total))


def bounded_sample(labelled: DataFrame, per_group: int, group: str, key: str) -> DataFrame:
    """About ``per_group`` rows of each ``group`` value (all of a smaller group), chosen by a hash of ``key``.

    Counting the groups reads ``group`` alone; a row is then kept or not on its own, so no group is gathered. The counts are
    written first, so that Spark knows their size and broadcasts them only if it is small.
    """
    counts = cut(labelled.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), short=True)
    return labelled.join(counts, group).where(hash_share(F.col(key).cast("string"), 17) * F.col("_n") < per_group).drop("_n")


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = FIT_PER_LANGUAGE, per_filter: int = PER_FILTER) -> LanguageFilters:
    """Fits filters on rows with a label: the ``per_filter`` most frequent n-grams of each language.

    Reads about ``per_language`` rows per language (see :func:`bounded_sample`); null texts have no n-grams. Tasks count the n-grams
    of some texts of a language at once; Spark sums the counts and ranks them; the driver gets ``per_filter`` numbers per language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(name: str, found: list[np.ndarray]) -> pd.DataFrame:
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            return pd.DataFrame({"lang": name, "gram": grams.view(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for name, part in batch.groupby("lang"):
                found, size = [], 0
                for x in part["text"]:
                    for hashes in ngram_hashes(x):
                        found.append(hashes)
                        size += len(hashes)
                        if size > 4 * CHUNK:
                            yield counted(name, found)
                            found, size = [], 0
                if found:
                    yield counted(name, found)

    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    counts = bounded_sample(rows, per_language, "lang", "key").select("text", "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= per_filter).select("lang", "gram").toPandas()
    return LanguageFilters.build({name: part["gram"].to_numpy(dtype=np.int64).view(np.uint64) for name, part in top.groupby("lang")})


def identify(documents: DataFrame, filters: LanguageFilters, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score (0 to 1) to every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. With no fitted language all are ``und``.
    Row-wise: rows, their number and other columns stay; columns named as ``into`` are replaced. Ties go to
    the language that sorts first.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)  # its size is fixed: SLOTS masks

    @F.pandas_udf("lang string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(x) for x in texts], columns=["lang", "score"])

    # so marked, a filter on the result doesn't make Spark evaluate it a second time
    decide = decide.asNondeterministic()
    bound_batches(documents.sparkSession)
    name, score = into
    kept = [c for c in documents.columns if c not in into]
    one = free_name("_found", documents.columns)
    found: Column = F.col(one)
    return documents.select(*kept, decide(F.col(text)).alias(one)).select(*kept, found["lang"].alias(name), found["score"].alias(score))
