"""Periodic runs (operator 12): online dyadic square catching over the words of a text.

A period q of 8 words or more lies in one octave [L, 2L), L a power of two. Once the block of words [b, b + L), b a multiple
of L, is complete, a catcher watches it: whenever word b + 2q is reached, it compares the suffix of q words with the q words
before it, and an equal pair is a square of period q that starts at b. A run of at least three periods holds such a
square for the first block that lies in it, so none is missed. Periods below 8 have catchers over blocks of 8, which a
run of 24 words holds. Comparisons use fingerprints of prefixes, a level's catchers side by side; what they find is
compared word by word, then followed to both sides, and squares of one period that meet are one run.

The work is a few array operations per octave and word, whatever the text repeats: a block starts few squares whose
root isn't itself periodic, and the others lie inside runs that are known by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_chunks

#: A run has this many words and this many periods at least. The catchers' blocks rely on 24 and 3; both may be larger.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of the smallest blocks.
SMALL = 8
#: Characters of a text that are split into words and appended at once.
CHUNK = 1 << 20
#: Comparisons made side by side.
SIDE = 1 << 15

Run = tuple[int, int, int]
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers never vanish
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the fingerprints' base, modulo 2^64; kept by the process."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate((_powers, _powers * np.uint64(pow(_BASE, len(_powers), 1 << 64))))
    return _powers[:n]


class RunCatcher:
    """Takes words as numbers, in order, and knows the runs of what it has taken so far."""

    def __init__(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
        if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
            raise ValueError(f"runs have {LEAST_WORDS} words and {LEAST_PERIODS} periods at least")
        self.least_words, self.least_periods, self.n = least_words, least_periods, 0
        self.words = np.empty(0, dtype=np.int64)
        self.sums = np.zeros(1, dtype=np.uint64)  # fingerprints of prefixes
        self.watched: dict[int, int] = {}  # blocks of each size whose catchers are done
        self.found: dict[int, list[list[int]]] = {}  # by period: start and end of stretches, in order
        self.covers: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def append(self, words: np.ndarray) -> None:
        """Further words. Runs that reached the end so far go on; catchers whose last comparison can be made now make theirs."""
        before = self.n
        self.n += len(words)
        if self.n > len(self.words):
            size = self.n if not before else max(self.n, 2 * len(self.words))
            self.words, self.sums = np.resize(self.words, size) if before else np.empty(size, dtype=np.int64), np.resize(self.sums, size + 1)
        self.words[before : self.n] = words
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xCA5A826395121157)
        np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers(self.n)[before:], out=self.sums[before + 1 : self.n + 1])
        self.sums[before + 1 : self.n + 1] += self.sums[before]
        for q, stretches in self.found.items():
            if stretches[-1][1] == before:
                stretches[-1][1] = self._right(before - q, q)
        self._catch(False)

    def runs(self) -> list[Run]:
        """``start, length, period`` of all runs, by start and period."""
        self._catch(True)
        return sorted((s, e - s, q) for q, stretches in self.found.items() for s, e in stretches if e - s >= max(self.least_words, self.least_periods * q))

    def _catch(self, last: bool) -> None:
        if self.n < LEAST_WORDS:
            return
        self.covers = {}
        self._catch_small(last)
        size = SMALL
        while 3 * size <= self.n:
            first, n, sums, times = self.watched.get(size, 0), self.n, self.sums, powers(2 * size)[size:]
            full = max(first, (n - 4 * size + 2) // size + 1)  # blocks before this one have all words that they are compared with
            side = max(1, SIDE // size)
            for i in range(first, full, side):
                shape = (min(side, full - i), size)
                at = sums[i * size : (full - 1) * size + 1 : size][: shape[0], None]
                middle = as_strided(sums[(i + 1) * size :], shape, (8 * size, 8))
                ends = as_strided(sums[(i + 2) * size :], shape, (8 * size, 16))
                block, step = np.nonzero((middle - at) * times == ends - middle)
                if len(block):
                    self._squares((i + block) * size, size + step, 2 * (size + step), size)
            self.watched[size] = full
            if last:
                for i in range(full, (n - 2 * size) // size + 1):
                    at, steps = i * size, (n - i * size) // 2 - size + 1
                    middle = sums[at + size : at + size + steps]
                    step = np.flatnonzero((middle - sums[at]) * times[:steps] == sums[at + 2 * size : at + 2 * size + 2 * steps - 1 : 2] - middle)
                    if len(step):
                        self._squares(np.full(len(step), at), size + step, 2 * (size + step), size)
            size *= 2

    def _catch_small(self, last: bool) -> None:
        first = self.watched.get(0, 0)
        for q in range(1, SMALL):
            full = (self.n - SMALL - (q if last else SMALL - 1)) // SMALL + 1
            if full > first:
                rows = lambda at: self.sums[at : at + (full - 1 - first) * SMALL + 1 : SMALL]  # noqa: B023, E731
                at = first * SMALL
                same = (rows(at + SMALL) - rows(at)) * powers(SMALL)[q] == rows(at + q + SMALL) - rows(at + q)
                block = np.flatnonzero(same)
                if len(block):
                    self._squares((first + block) * SMALL, np.full(len(block), q), np.full(len(block), SMALL + q), q)
        self.watched[0] = max(first, (self.n - 2 * SMALL + 1) // SMALL + 1)

    def _squares(self, starts: np.ndarray, periods: np.ndarray, sizes: np.ndarray, below: int) -> None:
        """Follows what catchers report: ``sizes`` words from ``starts`` on repeat with ``periods``, if fingerprints are right."""
        cover = self._cover(below)
        if cover:  # inside a stretch of a smaller period, the repeated words are periodic themselves
            at = np.searchsorted(cover[0], starts, "right") - 1
            apart = (at < 0) | (cover[1][at] < starts + sizes)
            starts, periods, sizes = starts[apart], periods[apart], sizes[apart]
        for b, q, size in zip(starts.tolist(), periods.tolist(), sizes.tolist(), strict=True):
            known = self.found.get(q)
            if known and b + size <= known[-1][1]:
                continue
            end = self._right(b, q)
            if end < b + size or not self._primitive(b, q):
                continue
            self.found.setdefault(q, []).append([self._left(b, q), end])

    def _cover(self, below: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Starts of the stretches of periods ``below`` a bound, and how far those up to there reach; they don't change while larger periods are caught."""
        if below not in self.covers:
            known = np.array(sorted((s, e) for q, x in self.found.items() if q < below for s, e in x))
            self.covers[below] = (known[:, 0], np.maximum.accumulate(known[:, 1])) if len(known) else None
        return self.covers[below]

    def _right(self, at: int, q: int) -> int:
        """Where the stretch of period ``q`` ends that has words ``at`` and ``at + q``."""
        step = 32
        while at + q < self.n:
            m = min(step, self.n - at - q)
            apart = np.flatnonzero(self.words[at : at + m] != self.words[at + q : at + q + m])
            if len(apart):
                return int(at + apart[0]) + q
            at, step = at + m, 4 * step
        return self.n

    def _left(self, at: int, q: int) -> int:
        """Where it starts."""
        step = 32
        while at > 0:
            m = min(step, at)
            apart = np.flatnonzero(self.words[at - m : at] != self.words[at - m + q : at + q])
            if len(apart):
                return int(at - m + apart[-1] + 1)
            at, step = at - m, 4 * step
        return 0

    def _primitive(self, at: int, q: int) -> bool:
        """Whether the ``q`` words from ``at`` on aren't a shorter sequence repeated."""
        root, rest, prime = self.words[at : at + q], q, 2
        while rest > 1:
            if prime * prime > rest:
                prime = rest
            if rest % prime == 0:
                d = q // prime
                if np.array_equal(root[d:], root[:-d]):
                    return False
                while rest % prime == 0:
                    rest //= prime
            prime += 1
        return True


def text_runs(text: str | None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[list[bytes], list[Run]]:
    """The words of a text, parted by ASCII white space, and their runs; null has no words."""
    catcher, ids, words = RunCatcher(least_words, least_periods), {}, []
    for chunk in text_chunks(text or "", CHUNK):
        part = chunk.encode("utf-8", "surrogatepass").split()  # parts at exactly these six white-space bytes
        words += part
        catcher.append(np.fromiter((ids.setdefault(x, len(ids)) for x in part), dtype=np.int64, count=len(part)))
    return words, catcher.runs()


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; of equals the first, then the one of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _map_runs(documents: DataFrame, into: str, make: Callable, text: str, keep: tuple[str, ...], least_words: int, least_periods: int) -> DataFrame:
    RunCatcher(least_words, least_periods)  # checks both on the driver
    return map_texts(documents, lambda: lambda x: make(*text_runs(x, least_words, least_periods)), into, text, keep)


def find_runs(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per run of each whole text: ``keep`` columns, ``start`` (word number from 0), ``length, period`` (words).

    A run is a stretch of words with smallest period ``period``, at least ``least_words`` long and ``least_periods`` periods,
    that can't be extended on either side. Words are parted by ASCII white space. Runs of one text may overlap. Null and
    empty texts have none; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    A text is one task's work, in memory of about 50 bytes per word.
    """
    packed = _map_runs(documents, "_runs string", lambda _, runs: (" ".join(",".join(map(str, r)) for r in runs),), text, keep, least_words, least_periods)
    one = packed.where("_runs <> ''").select(*keep, F.explode(F.split("_runs", " ")).alias("_run"))
    number = lambda i: F.split_part("_run", F.lit(","), F.lit(i)).cast("long")
    return one.select(*keep, *[number(i + 1).alias(c) for i, c in enumerate(("start", "length", "period"))])


def collapse_runs(documents: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Texts without what their runs repeat; texts without runs stay as they are, to the character.

    Of each run the first period stays; the words left of such a text are joined by one space. Null and empty texts stay,
    as do repeated rows, other columns and an empty table.
    """
    columns = documents.columns
    others = tuple(c for c in columns if c != text)
    packed = _map_runs(documents, "_now string", lambda words, runs: (b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass") if runs else None,), text, (*others, text), least_words, least_periods)
    return packed.toDF(*others, "_was", "_now").select(*[F.coalesce("_now", "_was").alias(c) if c == text else F.col(f"`{c}`") for c in columns])


DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest_runs(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row: the number of runs, the strongest (null without runs), and digests of all runs and of the collapsed words.

    ``runs_sha256``: of each run's ``start,length,period`` and a line feed, by start and period; ``collapsed_sha256``: of the
    words that :func:`collapse` leaves, joined by one space. Both are those of the empty string for null and empty texts
    (the former for every text without runs). Repeated rows stay; an empty table gives an empty one.
    """

    def make(words: list[bytes], runs: list[Run]) -> tuple:
        best = strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (
            len(runs),
            *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest(),
        )

    return _map_runs(documents, DIGESTS, make, text, keep, least_words, least_periods)


def plant_runs(text: Column, key: Column) -> Column:
    """Texts in which every tenth key makes words repeat: a known share of runs of known periods, whatever the texts.

    With h the CRC-32 of the key's decimal text and g = h / 10, in a text of n words whose h ends in 0 word i >= a becomes word
    a + (i - a) mod p, a = g mod n, p = 1 + (n - a) / (3 + g mod 8); its words are then joined by one space. Other texts
    stay. Nulls stay null; a null key changes nothing.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    blank = r"[\x20\x09-\x0D]+"

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # bound to a variable, as an expression inside a lambda runs for each element
        where = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])))
        return F.array_join(F.transform(F.get(where, F.lit(0)), lambda i: F.get(words, i.cast("int"))), " ")

    words = F.filter(F.split(text, blank), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), changed).otherwise(text)
