"""Quality rules (operator 7): rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at measures of one text and votes good (+1), bad (-1) or abstains (0). Without labels, EM over
the counts of vote patterns estimates how often each rule is right about good and about bad texts; the posterior
probability of being good then replaces a filter that demands that all rules pass.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, text_chunks

#: Characters of a text whose words are split at once.
CHUNK = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long, n_letters long, n_distinct long, n_bare long"
_BARE = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])[^A-Za-z0-9\x80-\xff \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])")


def repeated_words(w: np.ndarray, kinds: int) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first time included; ``w``: words as numbers below ``kinds``."""
    n = len(w) - 2
    if n < 2:
        return 0
    pairs = w[:-1] * kinds + w[1:]
    if kinds >= 1 << 20:  # a triple's code would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * kinds + w[2:]
    _, where, counts = np.unique(triples, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    covered = np.zeros(len(w), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``; null counts as no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    ids: dict[bytes, int] = {}
    found = []
    for chunk in text_chunks(text, CHUNK):  # bytes.split parts at exactly these six white-space bytes
        words = chunk.encode("utf-8", "surrogatepass").split()
        found.append(np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=len(words)))
    w = np.concatenate(found)
    tight = raw.translate(None, _SPACES)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    upper = sum(map(tight.count, (bytes([c]) for c in range(65, 91))))
    lower = sum(map(tight.count, (bytes([c]) for c in range(97, 123))))
    continued = len(tight) - len(tight.translate(None, bytes(range(128, 192))))
    return (
        len(w),
        len(tight) - continued,
        len(tight) - len(tight.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(w, len(ids)),
        upper,
        upper + lower + len(tight) - continued - len(tight.translate(None, bytes(range(128, 256)))),  # beyond ASCII: letters
        len(ids),
        len(_BARE.findall(raw)),
    )


def measure(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures every whole text; one row per row of ``documents``, with its columns ``keep``, which pass through untouched."""
    return map_texts(documents, lambda: measure_text, MEASURES, text, keep)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules. Between its two bounds, and on texts too small to tell, a rule abstains."""
    words, letters = F.col("n_words"), F.col("n_letters")
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    mean = share("word_chars", "n_words")
    return {
        "length": _vote(words < 10, words >= 300),
        "symbols": _vote(share("n_symbols", "n_words") > 0.25, (words >= 20) & (share("n_symbols", "n_words") < 0.05)),
        "dup_lines": _vote((F.col("n_dup_lines") >= 3) & (share("n_dup_lines", "n_lines") > 0.3), (F.col("n_lines") >= 4) & (share("n_dup_lines", "n_lines") < 0.1)),
        "repeats": _vote(share("n_repeat_words", "n_words") > 0.45, (words >= 30) & (share("n_repeat_words", "n_words") < 0.2)),
        "word_length": _vote((words >= 10) & ((mean > 15) | (mean < 2.5)), (words >= 20) & mean.between(3, 10)),
        "upper": _vote((letters >= 30) & (share("n_upper", "n_letters") > 0.5), (letters >= 60) & (share("n_upper", "n_letters") < 0.2)),
        "letters": _vote((words >= 10) & (share("n_letters", "word_chars") < 0.7), (words >= 20) & (share("n_letters", "word_chars") > 0.75)),
        "bare": _vote((words >= 10) & (share("n_bare", "n_words") > 0.15), (words >= 20) & (share("n_bare", "n_words") < 0.05)),
        "variety": _vote((words >= 50) & (share("n_distinct", "n_words") < 0.15), (words >= 50) & (share("n_distinct", "n_words") > 0.3)),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, prior: float = 0.7, rounds: int = 200) -> np.ndarray:
    """The posterior probability of good for each vote pattern, by EM over patterns weighted by ``counts``.

    Each rule has a chance of voting good on good texts and one of voting bad on bad texts. A rule looks for one
    defect, which most bad texts lack, so the latter starts low (0.2) and the former high (0.99): what EM learns from
    votes that come together is how much each defect says, and how little its absence does. Both are held within
    bounds that keep a rule's direction; abstentions carry no evidence, and pseudo-counts hold rules that hardly vote.
    """
    up, down = votes > 0, votes < 0
    right_good = np.full(votes.shape[1], 0.99)
    right_bad = np.full(votes.shape[1], 0.2)
    share = prior
    weight = counts / max(counts.sum(), 1)
    for _ in range(rounds):
        log_good = np.log(share) + up @ np.log(right_good) + down @ np.log1p(-right_good)
        log_bad = np.log1p(-share) + down @ np.log(right_bad) + up @ np.log1p(-right_bad)
        good = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        g, b = weight * good, weight * (1 - good)
        few = 1e-4
        new_good = np.clip((g @ up + 0.99 * few) / (g @ (up | down) + few), 0.9, 0.998)
        new_bad = np.clip((b @ down + 0.2 * few) / (b @ (up | down) + few), 0.11, 0.98)
        new_share = float(np.clip(g.sum(), 0.05, 0.95))
        done = max(np.abs(new_good - right_good).max(), np.abs(new_bad - right_bad).max(), abs(new_share - share)) < 1e-9
        right_good, right_bad, share = new_good, new_bad, new_share
        if done:
            break
    return good


def judge_quality(documents: DataFrame, least: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures of every text with ``p_good`` (posterior) and ``good`` (``p_good >= least``).

    The votes of all documents are counted by pattern; with 9 rules there are 3^9 = 19683 patterns at most, so
    the counts that reach the driver, and the posteriors that go back, have a fixed bound. Null and empty texts
    have no words; repeated rows stay; an empty table gives an empty result. Columns other than ``keep`` are ignored.
    """
    rules = rule_votes()
    measured = cut(measure(documents, text, keep))
    # a pattern is one number in base 3
    code = sum(((v + 1) * 3**i for i, v in enumerate(rules.values())), F.lit(0)).cast("int")
    coded = measured.withColumn("_pattern", code)
    counts = coded.groupBy("_pattern").count().orderBy("_pattern").toPandas()
    patterns = counts["_pattern"].to_numpy(dtype=np.int64)
    votes = np.stack([patterns // 3**i % 3 - 1 for i in range(len(rules))], axis=1) if len(patterns) else np.zeros((0, len(rules)), dtype=int)
    good = fit_votes(votes, counts["count"].to_numpy(dtype=float)) if len(patterns) else np.zeros(0)
    spark = documents.sparkSession
    fitted = spark.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good, strict=True)], "_pattern int, p_good double")
    return coded.join(F.broadcast(fitted), "_pattern", "left").drop("_pattern").withColumn("good", F.col("p_good") >= least)
