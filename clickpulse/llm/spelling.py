"""Spelling variants (operator 13): the vocabulary composed with one edit and with itself, partition by partition.

Two words at one edit agree in what lies left or right of the edit. So a partition holds the words of lengths m and m + 1 that share
their first characters, or their last ones: of the vocabulary's acceptor, it is the part behind one initial state (the state that
the shared characters lead to). A task minimises the acceptors of what a partition's words have between the shared ends, one for
each length, composes the shorter one with a transducer that replaces or inserts one symbol and with either acceptor again,
and walks the composition once; the edit is taken at the first difference, so each pair comes up once.

Partitions start as halves of a word. One that is larger than ``PARTITION`` is split at the middle of what its words don't
share yet, again and again: with one free symbol left, a partition has as many words as there are pairs of letters at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

LETTERS = "A-Za-zÀ-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points and occurrences that a word has at least.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A near word is a form if it occurs this many times as often.
RATIO = 5
#: Words of a partition before it is split.
PARTITION = 8192


class Acceptor:
    """The minimal acyclic automaton of some strings of one length; states are numbers, equal right languages are one state."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts
        states: dict[tuple, int] = {(): 0}
        path: list[list[tuple[str, int]]] = [[]]  # arcs of the states that the last string runs through

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                done = tuple(path.pop())
                if done not in states:
                    states[done] = len(self.arcs)
                    self.arcs.append(dict(done))
                symbol, _ = path[-1][-1]
                path[-1][-1] = symbol, states[done]

        before = ""
        for string in sorted(set(strings)):
            same = next((i for i, (a, b) in enumerate(zip(before, string, strict=False)) if a != b), min(len(before), len(string)))
            close(same)
            for symbol in string[same:]:
                path[-1].append((symbol, -1))
                path.append([])
            before = string
        close(0)
        done = tuple(path[0])
        self.start = states.setdefault(done, len(self.arcs))
        if self.start == len(self.arcs):
            self.arcs.append(dict(done))


def common(left: Acceptor, right: Acceptor, s: int, t: int, without: str = "") -> list[str]:
    """Strings that both acceptors take from states ``s`` and ``t``; the first symbol isn't ``without``."""
    out, path, stack = [], [], [(0, "", s, t)]
    while stack:
        depth, symbol, s, t = stack.pop()
        del path[max(0, depth - 1) :]
        if depth:
            path.append(symbol)
        if s == 0 and t == 0:
            out.append("".join(path))
            continue
        a, b = left.arcs[s], right.arcs[t]
        if len(b) < len(a):
            stack += [(depth + 1, x, a[x], b[x]) for x in b if x in a and (depth or x != without)]
        else:
            stack += [(depth + 1, x, a[x], b[x]) for x in a if x in b and (depth or x != without)]
    return out


def replaced(words: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of accepted strings that differ in one symbol: ``words`` o replacement o ``words``."""
    known: dict[int, list[tuple[str, str]]] = {}
    path, stack = [], [(0, "", words.start)]
    while stack:
        depth, symbol, s = stack.pop()
        del path[max(0, depth - 1) :]
        if depth:
            path.append(symbol)
        arcs = words.arcs[s]
        if s not in known:
            by = list(arcs.items())
            known[s] = [(x + z, y + z) for i, (x, a) in enumerate(by) for y, b in by[i + 1 :] for z in (common(words, words, a, b) if a != b else common(words, words, a, a))]
        if known[s]:
            head = "".join(path)
            yield from ((head + x, head + y) for x, y in known[s])
        stack += [(depth + 1, x, a) for x, a in arcs.items()]


def inserted(short: Acceptor, long: Acceptor, at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs of a string of ``short`` and that string with one more symbol in ``long``: ``short`` o insertion o ``long``.

    ``at_end``: whether the symbol may come after the whole shorter string.
    """
    path, stack = [], [(0, "", short.start, long.start)]
    while stack:
        depth, symbol, s, t = stack.pop()
        del path[max(0, depth - 1) :]
        if depth:
            path.append(symbol)
        if s or at_end:
            for x, b in long.arcs[t].items():
                found = common(short, long, s, b, x)
                if found:
                    head = "".join(path)
                    yield from ((head + z, head + x + z) for z in found)
        a, b = short.arcs[s], long.arcs[t]
        stack += [(depth + 1, x, a[x], b[x]) for x in a if x in b]


def near_pairs(words: list[str], length: int, left: int, right: int) -> Iterator[tuple[str, str]]:
    """Pairs at one edit of a partition: words of ``length`` and one more symbol that share ``left`` first and ``right`` last symbols.

    Pairs of two longer words belong to another partition, as do those that first differ where the shared end begins.
    """
    short, long = ([w[left : len(w) - right] for w in words if len(w) == n] for n in (length, length + 1))
    head, tail = words[0][:left], words[0][len(words[0]) - right :]
    if short:
        acceptor = Acceptor(short)
        for x, y in replaced(acceptor) if len(short) > 1 else ():
            yield head + x + tail, head + y + tail
        for x, y in inserted(acceptor, Acceptor(long), not right) if long else ():
            yield head + x + tail, head + y + tail


def letter_runs(documents: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """Adds ``word``: each maximal run of Latin letters of ``least_length`` or more in the whole text, A to Z lower-cased.

    A row per run; rows of texts without one, null texts among them, go; repeated rows stay.
    """
    runs = documents.withColumn("word", F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))))
    return runs.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", _UPPER, _UPPER.lower())).otherwise(F.col("word")))


def plant_misspellings(word: Column, key: Column) -> Column:
    """Words of which a known share lacks a letter, whatever the texts.

    With h the CRC-32 of ``key:word``, a word whose h is a multiple of 199 loses the code point at h mod its length.
    A null key changes nothing.
    """
    h = F.crc32(F.concat_ws(":", key.cast("string"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(key.isNotNull() & (h % 199 == 0), F.concat(F.left(word, at), F.substr(word, at + 2))).otherwise(word)


def count_words(rows: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the distinct words of ``rows`` that are long and frequent enough. Null words count as none."""
    counted = rows.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _key() -> Column:
    shared = F.concat(F.left("word", F.col("left")), F.right("word", F.col("right")))
    return F.concat_ws(":", F.col("length").cast("string"), F.col("left").cast("string"), F.col("right").cast("string"), shared)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: what lies between the shared ends is halved, and either half becomes shared."""
    free = F.col("length") - F.col("left") - F.col("right")
    half = F.floor(free / 2).cast("int")
    both = F.array(F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right")), F.struct(F.col("left").alias("left"), (F.col("right") + free - half).alias("right")))
    split = rows.select("word", "n", "length", F.explode(both).alias("_ends")).select("word", "n", "length", "_ends.left", "_ends.right")
    return split.withColumn("key", _key())


PARTIALS = "word string, n_near long, near string, near_n long"
_PARTIALS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[str, int, str, int]] = []
        for length, left, right, words, counts in zip(*(c for c in batch.columns), strict=True):
            words = words.as_py()
            n = dict(zip(words, counts.as_py(), strict=True))
            near: dict[str, tuple[int, int, str]] = {}
            for pair in near_pairs(words, length.as_py(), left.as_py(), right.as_py()):
                for a, b in (pair, pair[::-1]):
                    many, minus, best = near.get(a, (0, 0, ""))
                    near[a] = (many + 1, *min((minus, best), (-n[b], b)))
            found += [(w, many, best, -minus) for w, (many, minus, best) in near.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(_PARTIALS.types)], schema=_PARTIALS)


def near_words(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """``word, n_near, near, near_n``: of each word with any, how many words are at one edit, and the most frequent of them.

    ``words``: ``word, n``, each word once. Of equally frequent near words it is the first in code-point order.
    """
    spark = words.sparkSession
    bound_batches(spark)
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"), F.lit(0).alias("left"), F.lit(0).alias("right")).where("length > 0")
    rows = _halves(rows)
    ready = []
    while True:
        # a row per partition of more than ``partition`` words; those of one free symbol can't be split and are small
        large = rows.where(F.col("length") - F.col("left") - F.col("right") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > partition).select("key")
        large = cut(large)
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "key", "left_anti"))
        rows = cut(_halves(rows.join(large, "key", "left_semi")))
    partials = []
    for part in ready:
        groups = part.groupBy("key").agg(
            F.first("length").alias("length"), F.first("left").alias("left"), F.first("right").alias("right"),
            F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("word", "n")).alias("rows"),
        ).where("_n > 1")
        partials.append(groups.select("length", "left", "right", "rows.word", "rows.n").mapInArrow(_compose, PARTIALS))
    met = partials[0]
    for more in partials[1:]:
        met = met.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.minus")).alias("near_n"))


def group_variants(words: DataFrame, ratio: int = RATIO, partition: int = PARTITION) -> DataFrame:
    """Groups spelling variants: ``word, form, root, n, n_near, form_n``, one row per word of ``words`` (``word, n``, each word once).

    ``n_near``: words at one inserted, deleted or replaced code point. ``form``: the most frequent of them (ties: the smallest in
    code-point order), if it occurs ``ratio`` times as often as the word or more; else null, as is ``form_n``, its count.
    ``root``: from the word along forms to the last; the word itself without one. An empty table gives an empty one.

    Counts grow by ``ratio`` (2 at least) with each form, so chains have fewer than 64 of them, and following what was followed
    before reaches their ends in six joins at most; it stops when nothing goes on.
    """
    if ratio < 2:
        raise ValueError("a form occurs at least twice as often")
    words = cut(words.select("word", "n"))
    near = near_words(words, partition)
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = cut(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    )
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        followed = cut(roots.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        roots = followed.select("word", "root")
        if followed.where("_on").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
