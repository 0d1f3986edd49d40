"""Toxicity (operator 11): a weighted finite-state grammar of clauses.

Deterministic transducers for insults, targets, negation, reported speech and threats are composed to one machine that reads a
clause word by word and gives each insult or threat the weight of what it is part of: aimed at somebody it counts more, negated
or reported less. The insult transducer is learned: an automaton of word heads and whole words that labelled toxic texts have and
clean ones lack, each with the log odds of its documents; a word takes the weight of the longest one it starts with. Heads, since
an insult's compounds and inflections share them. The others hold fixed words of four languages.

A document's score is a logistic function, fitted on the same labelled sample, of what its matched clauses weigh, in all and
for the text's length.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, map_texts

#: Labelled documents of each kind that the insults and the score are fitted on, at most.
FIT_TOXIC = 3000
FIT_CLEAN = 6000
#: Code points of a head at most, and at least; a whole word may be longer by its end.
LONGEST, SHORTEST = 14, 3
END = "$"
#: Log likelihood ratio that an insult needs, and toxic documents.
LEAST_EVIDENCE = 12.0
LEAST_DOCUMENTS = 3
#: Heads that the choice starts from, the strongest ones, and those it ends with, at most.
CANDIDATES = 4096
INSULTS = 1024
#: Insults that explain a document: its other words are no longer evidence.
EXPLAINED = 6
#: Words of a shingle, by whose least hashes near copies are found: these share all their words, which so would be evidence.
SHINGLE = 5

# Words by what they stand for, in English, German, Spanish and French.
WORDS = {
    "target": "you your yourself ya u he she they him her them his their du dich dir dein deine ihr euch er sie ihn tú tu te ti usted ustedes él ella ellos vous toi vos il elle ils elles lui leur",
    "not": "not no never isn aren wasn don doesn didn nor neither nicht kein keine keiner nie niemals nunca jamás tampoco ni ne pas jamais aucun aucune",
    "said": "said says say called calls wrote writes told tells quoted reported claimed sagte sagt nannte schrieb behauptete dijo dice llamó escribió dit disait appelé écrit",
    "will": "will shall gonna going ll werde werden wird voy vamos iré vais vas allons irai",
    "harm": "kill hurt beat shoot stab destroy murder töten umbringen schlagen erschießen matar golpear disparar tuer frapper détruire",
}
KIND_OF = {word: kind for kind, words in WORDS.items() for word in words.split()}
#: Words that each annotation reaches.
REACH = {"not": 3, "target": 4, "will": 3}
#: What an annotation multiplies a weight by, and the weight of a threat.
AIMED, NEGATED, REPORTED, THREAT = 1.25, 0.25, 0.4, 6.0

_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"[.!?;:\n…]")

Symbol = tuple[str, str]  # kind, annotations


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol]`` is the next state and the symbol that is written; every clause begins in state 0."""

    alphabet: tuple[Symbol, ...]
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]]

    @classmethod
    def of(cls, start: object, alphabet: Iterable[Symbol], rule: Callable[[object, Symbol], tuple[object, Symbol]]) -> Transducer:
        """From a rule over states of any kind; those that can be reached are numbered."""
        alphabet, number, arcs = tuple(alphabet), {start: 0}, {}
        todo = [start]
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                after, written = rule(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[number[state], symbol] = number[after], written
        return cls(alphabet, arcs)

    @cached_property
    def written(self) -> tuple[Symbol, ...]:
        return tuple(sorted({w for _, w in self.arcs.values()}))

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def rule(states: tuple[int, int], symbol: Symbol) -> tuple[tuple[int, int], Symbol]:
            mine, written = self.arcs[states[0], symbol]
            theirs, written = other.arcs[states[1], written]
            return (mine, theirs), written

        return Transducer.of((0, 0), self.alphabet, rule)


_MARKED = ("insult", "harm")


def reported(alphabet: Iterable[Symbol]) -> Transducer:
    """What follows a verb of saying, or stands in quotation marks, is somebody else's."""

    def rule(state: str, symbol: Symbol) -> tuple[str, Symbol]:
        kind, notes = symbol
        if kind == "said":
            return "said", symbol
        if kind == "quote":
            return ("open" if state != "open" else ""), symbol
        return state, (kind, notes + "r") if state and kind in _MARKED else symbol

    return Transducer.of("", alphabet, rule)


def _within(opening: str, note: str, alphabet: Iterable[Symbol]) -> Transducer:
    """Marks what comes within some words after an opening kind."""

    def rule(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, notes = symbol
        if kind == opening:
            return REACH[opening], symbol
        return max(0, left - 1), (kind, notes + note) if left and kind in _MARKED else symbol

    return Transducer.of(0, alphabet, rule)


def aimed_after(alphabet: Iterable[Symbol]) -> Transducer:
    """A target that follows an insult makes that one aimed, too: it is written as ``aim``."""

    def rule(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        if symbol[0] == "insult":
            return (0 if "a" in symbol[1] else REACH["target"]), symbol
        if symbol[0] == "target" and left:
            return 0, ("aim", "")
        return max(0, left - 1), symbol

    return Transducer.of(0, alphabet, rule)


def threats(alphabet: Iterable[Symbol]) -> Transducer:
    """A harmful verb is a threat if somebody is about to do it."""

    def rule(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, notes = symbol
        if kind == "will":
            return REACH["will"], symbol
        return max(0, left - 1), ("threat", notes) if left and kind == "harm" else symbol

    return Transducer.of(0, alphabet, rule)


def clause_grammar() -> Transducer:
    """All of them composed: words' kinds in, annotated insults and threats out."""
    machine = reported((kind, "") for kind in ("other", "insult", "quote", *WORDS))
    for more in (lambda x: _within("not", "n", x), lambda x: _within("target", "a", x), aimed_after, threats):
        machine = machine.then(more(machine.written))
    return machine


def _factor(notes: str) -> float:
    return (AIMED if "a" in notes else 1.0) * (NEGATED if "n" in notes else 1.0) * (REPORTED if "r" in notes else 1.0)


@dataclass(frozen=True)
class ToxicityModel:
    """``insults``: weights by head, or by whole word with ``END``. ``logistic``: of :meth:`measure`, the constant first."""

    insults: dict[str, float]
    logistic: tuple[float, ...]
    grammar: Transducer = field(default_factory=clause_grammar)

    @cached_property
    def _finder(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word in {*(x.removesuffix(END) for x in self.insults), *WORDS["harm"].split()}:
            found.add_word(word, len(word))
        if len(found):
            found.make_automaton()
        return found

    def weight(self, word: str) -> float:
        """Of the longest insult that a word starts with; the whole word first. 0 without one."""
        found = self.insults.get(word + END)
        size = min(len(word), LONGEST)
        while found is None and size >= SHORTEST:
            found = self.insults.get(word[:size])
            size -= 1
        return found or 0.0

    def clause(self, text: str) -> tuple[float, int]:
        """What a lower-cased clause weighs, and how many insults and threats it has."""
        state, weighs, matches, last, arcs = 0, 0.0, 0, 0.0, self.grammar.arcs
        for token in _TOKEN.findall(text):
            kind = KIND_OF.get(token) or ("other" if token[0].isalpha() else "quote")
            weight = self.weight(token) if kind == "other" else 0.0
            state, (kind, notes) = arcs[state, ("insult" if weight else kind, "")]
            if kind == "insult":
                last = weight * _factor(notes)
            elif kind == "threat":
                last = THREAT * _factor(notes)
            elif kind == "aim":
                weighs += last * (AIMED - 1)
                continue
            else:
                continue
            weighs += last
            matches += 1
        return weighs, matches

    def measure(self, text: str | None) -> tuple[float, ...]:
        """What the matched clauses of a text weigh, the same for its length, how many matches they have, and the length; damped."""
        text = (text or "").lower()
        weighs, matches, ends, done = 0.0, 0, None, -1
        if text and len(self._finder):
            for end, size in self._finder.iter(text):
                start = end - size + 1
                if start < done or (start and _LETTER.match(text[start - 1])):
                    continue
                if ends is None:
                    ends = [-1, *(m.start() for m in _ENDS.finditer(text)), len(text)]
                after = bisect_left(ends, start)
                done = ends[after]
                w, m = self.clause(text[ends[after - 1] + 1 : done])
                weighs, matches = weighs + w, matches + m
        return math.log1p(weighs), math.log1p(600 * weighs / (len(text) + 120)), math.log1p(matches), math.log1p(len(text))

    def score(self, text: str | None) -> float:
        constant, *slopes = self.logistic
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, constant + sum(a * b for a, b in zip(slopes, self.measure(text), strict=True))))))


def heads(text: str | None) -> set[str]:
    """Heads of a text's words, and the words themselves with ``END``."""
    found: set[str] = set()
    for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        if len(word) >= SHORTEST:
            found.update(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
            if len(word) <= LONGEST:
                found.add(word + END)
    return found


def sketch(text: str | None) -> tuple[int, int]:
    """Least hashes of a text's shingles under two functions: near copies have at least one in common most of the time."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    raw = [" ".join(words[i : i + SHINGLE]).encode() for i in range(max(1, len(words) - SHINGLE + 1))]
    return min(map(zlib.crc32, raw)), min(zlib.crc32(x, 0x5EED) for x in raw)


def evidence(toxic: Column, clean: Column, n_toxic: Column | int, n_clean: Column | int) -> Column:
    """Log likelihood ratio of a word being as frequent in both kinds against its being more frequent in toxic texts; 0 if it isn't."""

    def term(k: Column, of: Column, share: float) -> Column:
        return F.when(k > 0, k * F.log(k / of / share)).otherwise(0.0)

    share = n_toxic / (n_toxic + n_clean)
    has, lacks = toxic + clean, (n_toxic + n_clean) - toxic - clean
    llr = term(toxic, has, share) + term(clean, has, 1 - share) + term(n_toxic - toxic, lacks, share) + term(n_clean - clean, lacks, 1 - share)
    return F.when(toxic > share * has, llr).otherwise(0.0)


def _choose(names: list[str], has: np.ndarray, clean: np.ndarray, n_clean: int) -> dict[str, float]:
    """Insults that explain most toxic documents first; ``has``: documents by candidates, ``clean``: clean documents of each."""
    chosen: dict[str, float] = {}
    hits, total, size = np.zeros(len(has), dtype=int), has.sum(0), np.array([len(n) for n in names])
    open_ = np.ones(len(names), dtype=bool)
    while open_.any() and len(chosen) < INSULTS:
        left = hits < EXPLAINED
        n, a = int(left.sum()), has[left].sum(0).astype(float)
        if not n:
            break
        share = n / (n + n_clean)

        def term(k: np.ndarray, of: np.ndarray, p: float) -> np.ndarray:
            return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(of, 1) / p), 0.0)

        both, rest = a + clean, n + n_clean - a - clean
        llr = term(a, both, share) + term(clean, both, 1 - share) + term(n - a, rest, share) + term(n_clean - clean, rest, 1 - share)
        llr[(a <= share * both) | (a < LEAST_DOCUMENTS) | ~open_] = 0
        best = np.lexsort((size, llr.round(9)))[-1]  # of equals the longest
        if llr[best] < LEAST_EVIDENCE:
            break
        chosen[names[best]] = float(np.log((total[best] + 0.5) / (len(has) + 1)) - np.log((clean[best] + 0.5) / (n_clean + 1)))
        hits += has[:, best]
        open_[best] = False
    return {k: w for k, w in chosen.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton's method; the constant isn't held."""
    x = np.column_stack((np.ones(len(x)), x))
    held = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + held, x.T @ (weight * (p - y)) + held @ theta)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, theta))


def fit_toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns insults and the score from labelled documents.

    ``labels``: keys with 1 for toxic and 0 for clean; a key that it repeats counts once, as toxic if one row says so; null
    keys and labels are ignored. At most ``FIT_TOXIC`` and ``FIT_CLEAN`` labelled keys take part, those with the smallest
    hashes; a key that several documents have stands for one of their texts. Both kinds weigh in the score as they do among
    all labels. Without toxic or without clean texts the score is the share of toxic ones (0 without labels).
    """
    spark = documents.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"))
    known = cut(known.select("key", "toxic", F.xxhash64("key").alias("draw")))
    everyone = dict(known.groupBy("toxic").count().collect())
    drawn = [known.where(F.col("toxic") == kind).orderBy("draw", "key").limit(most) for kind, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    sample = cut(drawn[0].union(drawn[1]).select("key", "toxic"))  # FIT_TOXIC + FIT_CLEAN rows at most
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    # near copies, however many keys they have, are one document
    texts = cut(texts.groupBy("key").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).where("text is not null"))
    texts = map_texts(texts, lambda: sketch, "one long, two long", keep=("key", "text", "toxic"))
    for least, others in (("one", ("key", "text", "two")), ("two", ("key", "text"))):
        texts = texts.groupBy(least).agg(F.min(F.struct(*others)).alias("row"), F.max("toxic").alias("toxic")).select("row.*", "toxic")
    texts = cut(texts.select(F.xxhash64("key").alias("blob"), "text", "toxic"))
    sizes = dict(texts.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share = everyone.get(1, 0) / max(1, sum(everyone.values()))
    if not n_toxic or not n_clean:
        return ToxicityModel({}, (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0, 0.0))
    insults = _learn_insults(texts, n_toxic, n_clean)
    untrained = ToxicityModel(insults, ())
    shipped = spark.sparkContext.broadcast(untrained)
    measured = map_texts(texts, lambda: shipped.value.measure, ", ".join(f"m{i} double" for i in range(4)), keep=("toxic",)).toPandas()
    y = measured["toxic"].to_numpy(dtype=float)
    weight = np.where(y == 1, share / n_toxic, (1 - share) / n_clean) * len(y)
    return ToxicityModel(insults, _logistic(measured[[f"m{i}" for i in range(4)]].to_numpy(), y, weight))


def _learn_insults(texts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    bound_batches(texts.sparkSession)

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, toxic, value in zip(batch["blob"], batch["toxic"], batch["text"], strict=True):
                found = pa.array(list(heads(value.as_py())), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([blob.as_py()] * len(found), pa.int64()), pa.array([toxic.as_py()] * len(found), pa.int32()), found], ["blob", "toxic", "head"])

    rows = texts.select("blob", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(heads_of, "blob long, toxic int, head string")
    counts = rows.groupBy("head").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    strong = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("llr", evidence(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).where(F.col("llr") >= LEAST_EVIDENCE)
    best = strong.orderBy(F.desc("llr"), "head").limit(CANDIDATES).select("head", "clean").collect()  # CANDIDATES rows at most
    names = [r["head"] for r in best]
    index = texts.sparkSession.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def mark(value: str | None) -> tuple[str]:
        return (" ".join(str(index.value[x]) for x in heads(value) if x in index.value),)

    held = map_texts(texts.where("toxic = 1"), lambda: mark, "found string", keep=("blob",)).select("found").toPandas()["found"]  # FIT_TOXIC rows at most
    has = np.zeros((len(held), len(names)), dtype=bool)
    for row, found in enumerate(held):
        has[row, np.array(found.split(), dtype=int)] = True
    return _choose(names, has, np.array([r["clean"] for r in best], dtype=float), n_clean)


def score_toxicity(documents: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """``keep`` columns of every row and the score of its whole text, from 0 to 1.

    Null and empty texts have no clause and the score of a text without matches; repeated rows score alike; an empty table
    gives an empty one. Row by row, no shuffle; a text is scanned once, and only clauses with a match are read by the grammar.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[str | None], tuple]:
        found = shipped.value
        return lambda value: (found.score(value),)

    return map_texts(documents, start, f"`{into}` double", text, keep)
