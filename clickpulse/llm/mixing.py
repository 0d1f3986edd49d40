"""Mixing sources to target weights (operator 1), on built-in functions only.

Membership in a domain is soft: a classifier that is fitted on a table of labels gives each document a posterior
over domains. Nonnegative document rates are then fitted by projected-gradient least squares, so that the expected
tokens of each domain (the sum of rate x tokens x posterior) meet their targets while rates stay near 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, hash_share

#: Hash buckets of pieces.
BUCKETS = 1 << 14
#: The most telling buckets that the classifier keeps, and how telling one must be: by chi-square against equal shares, and
#: by the logarithm of its largest rate over its smallest.
FEATURES = 512
LEAST_CHI_SQUARE = 12.0
LEAST_LIFT = 1.0
#: Labelled documents per domain that a fit reads, chosen by a hash of the key; the fit's stated bound.
FIT_PER_DOMAIN = 4000


def words_of(text: Column) -> Column:
    """Lower-cased words, parted by white space; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def pieces_of(text: Column) -> Column:
    """Lower-cased runs of letters, of digits and of other characters but white space: what the classifier reads."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\pL++|\pN++|[^\pL\pN\x20\x09-\x0D]++"), F.lit(0))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def label_sample(labels: DataFrame, per_domain: int, key: str, domain: str) -> DataFrame:
    """``key, domain, _times``: about ``per_domain`` labelled keys of each domain (all of a smaller one), chosen by a hash of the key.

    A key that has the same label several times is one row and one of those counted, so repeats make the sample no larger.
    """
    once = labels.groupBy(key, domain).agg(F.count(F.lit(1)).alias("_times"))
    counts = once.groupBy(domain).agg(F.count(F.lit(1)).alias("_n"))
    chosen = once.join(F.broadcast(counts), domain)  # a row per domain
    return chosen.where(hash_share(F.col(key).cast("string"), 29) * F.col("_n") < per_domain).select(key, domain, "_times")


@dataclass(frozen=True)
class DomainModel:
    """``prior``: log shares of labels by domain. ``lift``: by kept bucket, log rates among a domain's pieces.

    ``other``: log rates of all other pieces together. Rates are relative to their mean over domains.
    """

    prior: np.ndarray
    lift: dict[int, np.ndarray]
    other: np.ndarray

    def buckets(self) -> list[int]:
        return sorted(self.lift)

    def constant(self, values: list, kind: str) -> Column:
        """One constant array; spelled as text, which Spark folds, as a literal for each value would swell the plan."""
        return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def fit_domains(documents: DataFrame, labels: DataFrame, domains: list[str], per_domain: int = FIT_PER_DOMAIN, key: str = "doc_id", text: str = "text", domain: str = "domain") -> DomainModel:
    """A multinomial naive Bayes model of hashed pieces of words: the telling ones, and all others as one.

    A bucket that a document holds c times counts log(1 + c), so that a few long texts don't make common words telling,
    nor a long text's repetitions decide; each other bucket counts as if it came once. Reads about ``per_domain``
    labelled documents of each domain (a broadcast of that bounded sample of keys finds them; a label or text given twice
    for a key adds to its counts), but the priors count all labels. Buckets are ranked by chi-square in Spark; the
    driver gets those kept.
    """
    labels = labels.where(F.col(domain).isin(domains) & F.col(key).isNotNull()).select(key, domain)
    prior = {r[domain]: r["count"] for r in labels.groupBy(domain).count().collect()}
    sample = label_sample(labels, per_domain, key, domain)
    logs = np.log(np.array([prior.get(d, 0) for d in domains], dtype=float) + 1)
    logs -= np.log(np.exp(logs).sum())
    keys = F.broadcast(sample.select(F.col(key).alias("key"), F.col(domain).alias("domain"), "_times"))
    read = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(keys, "key")
    pieces = read.select("key", "domain", "_times", F.explode(F.transform(pieces_of(F.col("text")), _bucket)).alias("bucket"))
    held = pieces.groupBy("key", "domain", "bucket").agg(F.sum("_times").alias("count"))
    names, texts = [[f"{c}{i}" for i in range(len(domains))] for c in "nm"]
    damped = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.log1p("count"))), F.lit(0.0)).alias(n) for n, d in zip(names, domains, strict=True)]
    counts = cut(held.groupBy("bucket").agg(*damped, *[F.count_if(F.col("domain") == d).alias(n) for n, d in zip(texts, domains, strict=True)]))  # BUCKETS rows at most
    sums = counts.agg(*[F.sum(n).alias(n) for n in (*names, *texts)]).first()
    total = np.array([sums[n] or 0 for n in names], dtype=float)
    if not total.sum():
        return DomainModel(logs, {}, np.zeros(len(domains)))
    have = [i for i, x in enumerate(total) if x]
    of_bucket = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    expected = {i: of_bucket * float(total[i] / total.sum()) for i in have}
    chi = reduce(lambda a, b: a + b, [F.pow(F.col(names[i]) - expected[i], 2) / expected[i] for i in have])
    rates = F.array(*[F.log((F.col(names[i]) + 0.5) / F.lit(float(total[i]))) for i in have])
    telling = (F.col("chi") >= LEAST_CHI_SQUARE) & (F.array_max(rates) - F.array_min(rates) >= LEAST_LIFT)
    kept = counts.withColumn("chi", chi).where(telling).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    mass = {r["bucket"]: np.array([r[n] for n in names], dtype=float) for r in kept}
    other = np.log(2) * np.array([sums[n] - sum(r[n] for r in kept) for n in texts], dtype=float)
    whole = other + sum(mass.values(), np.zeros(len(domains)))

    def against_mean(rate: np.ndarray) -> np.ndarray:
        made = np.zeros(len(domains))
        made[have] = np.log((rate[have] + 0.5) / whole[have])
        made[have] -= made[have].mean()
        return made

    return DomainModel(logs, {b: against_mean(n) for b, n in mass.items()}, against_mean(other))


def posterior(text: Column, model: DomainModel) -> Column:
    """An array of domain chances for a text, computed in place from all its words; without words the priors."""
    if not model.lift:
        return F.array(*[F.lit(float(x)) for x in np.exp(model.prior)])
    kept = model.buckets()
    numbers = dict(zip(kept, range(1, len(kept) + 1), strict=True))
    places = model.constant([numbers.get(b, 0) for b in range(BUCKETS)], "int")  # found by index: a text has many words
    tables = [model.constant([float(model.lift[b][k]) for b in kept], "double") for k in range(len(model.prior))]
    zero = F.struct(F.lit(0).alias("place"), F.lit(0).alias("times"), *[F.lit(0.0).alias(f"d{k}") for k in range(len(tables))])

    def add(acc: Column, place: Column) -> Column:
        """Places come sorted; the c-th time of one adds log(1 + c) - log(c)."""
        times = F.when(acc["place"] == place, acc["times"] + 1).otherwise(1)
        gain = F.log((times + 1) / times)
        return F.struct(place.alias("place"), times.alias("times"), *[(acc[f"d{k}"] + gain * F.get(t, place - 1)).alias(f"d{k}") for k, t in enumerate(tables)])

    def chances(s: Column) -> Column:
        logs = F.array(*[float(p) + s["seen"][f"d{k}"] + s["others"] * float(np.log(2) * o) for k, (p, o) in enumerate(zip(model.prior, model.other, strict=True))])
        return F.transform(F.array(logs), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0]

    def weigh(buckets: Column) -> Column:
        telling = F.filter(F.transform(buckets, lambda b: F.get(places, b)), lambda place: place > 0)  # few of a text
        return F.transform(F.array(telling), lambda found: F.struct(F.aggregate(F.sort_array(found), zero, add).alias("seen"), (F.size(F.array_distinct(buckets)) - F.size(F.array_distinct(found))).alias("others")))[0]

    seen = F.transform(F.array(F.transform(pieces_of(text), _bucket)), weigh)
    raw = F.transform(seen, chances)[0]
    return F.transform(F.array(raw), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def fit_rates(members: DataFrame, targets: np.ndarray, rounds: int = 40, close: float = 1e-4) -> list[np.ndarray]:
    """Steps of projected-gradient least squares; ``members`` has ``tokens`` and ``chances``.

    Minimises the squared gaps between expected domain tokens and ``targets`` over rates >= 0, from rates of 1.
    Gradients are scaled by 1 / tokens (so the length of a document doesn't decide) and gaps by the inverse of the
    domains' Gram matrix over documents whose rate is above 0. A document's rate follows from its chances and the steps
    alone, so a round is one aggregation with a few numbers per domain; the rates are never gathered. It ends when the
    gaps are ``close`` (as a part of the targets). When they no longer shrink (targets out of reach), or after ``rounds``,
    the fit goes on from the rates of the smallest squared gap with steps of which each is searched for its length.
    """
    k = len(targets)
    p = [F.get("chances", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The gaps after ``steps`` and the Gram matrix of the documents that still have a rate."""
        rated = members.select("tokens", "chances", rate_of(F.col("chances"), steps).alias("rate"))
        moves = F.when(F.col("rate") > 0, F.col("tokens"))
        row = rated.agg(
            *[F.sum(F.col("rate") * F.col("tokens") * p[i]).alias(f"s{i}") for i in range(k)],
            *[F.sum(moves * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs],
        ).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]) - targets, gram

    def scaled(gap: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(np.trace(gram), 1e-9)) @ gap

    steps: list[np.ndarray] = []
    best, stuck, least, kept, steepest = np.inf, 0, np.inf, 0, 0.0
    for n in range(rounds + 1):
        gap, gram = measure(steps)
        wrong = np.abs(gap).sum()
        if wrong <= close * max(targets.sum(), 1e-9):
            return steps
        if n == 0:
            steepest = np.linalg.eigvalsh(gram)[-1]
        if gap @ gap < least:
            least, kept = gap @ gap, n
        stuck = 0 if wrong < 0.999 * best else stuck + 1
        best = min(best, wrong)
        if stuck > 4 or n == rounds:
            break
        steps.append(scaled(gap, gram))
    steps, stuck = steps[:kept], 0
    for _ in range(rounds if steepest > 0 else 0):
        gap, gram = measure(steps)
        # the scaled step may not shrink the gap where rates are cut off at 0; the plain one of length 1 always does
        tries = [scaled(gap, gram) * x for x in (1, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 64)] + [gap / steepest * x for x in (1, 4, 16, 64, 256)]
        rated = members.select("tokens", "chances", rate_of(F.col("chances"), steps).alias("rate"))
        moved = rated.select("tokens", "chances", *[moved_by(F.col("rate"), F.col("chances"), x).alias(f"r{t}") for t, x in enumerate(tries)])
        row = moved.agg(*[F.sum(F.col(f"r{t}") * F.col("tokens") * p[i]).alias(f"s{t}_{i}") for t in range(len(tries)) for i in range(k)]).first()
        gaps = [np.array([row[f"s{t}_{i}"] or 0.0 for i in range(k)]) - targets for t in range(len(tries))]
        t = int(np.argmin([g @ g for g in gaps]))
        if not gaps[t] @ gaps[t] < least:
            break
        steps.append(tries[t])
        stuck = 0 if gaps[t] @ gaps[t] < 0.999 * least else stuck + 1
        least = gaps[t] @ gaps[t]
        if stuck > 4 or np.abs(gaps[t]).sum() <= close * max(targets.sum(), 1e-9):
            break
    return steps


def moved_by(rate: Column, chances: Column, step: np.ndarray) -> Column:
    """A rate after one more step, cut off at 0."""
    return F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, [F.get(chances, F.lit(i)) * float(x) for i, x in enumerate(step)]))


def rate_of(chances: Column, steps: list[np.ndarray]) -> Column:
    """A document's rate after ``steps``: from 1, each step moves it and cuts it off at 0."""
    return reduce(lambda rate, step: moved_by(rate, chances, step), steps, F.lit(1.0))


def memberships(documents: DataFrame, model: DomainModel, text: str = "text", into: tuple[str, str] = ("tokens", "chances")) -> DataFrame:
    """Adds the words of a text and the posterior by domain to each row, as the columns ``into``; row-wise, no shuffle."""
    kept = [c for c in documents.columns if c not in into]
    value = F.col(text)
    return documents.select(*kept, F.size(words_of(value)).cast("long").alias(into[0]), posterior(value, model).alias(into[1]))


def with_rates(members: DataFrame, steps: list[np.ndarray], draw: Column, chances: str = "chances", into: tuple[str, str] = ("rate", "copies")) -> DataFrame:
    """Adds rate and copies as the columns ``into``: a rate's whole part, and one more where ``draw`` falls below the rest."""
    kept = [c for c in members.columns if c not in into]
    drawn = free_name("_draw", kept, list(into))
    rate = F.col(into[0])
    members = members.select(*kept, rate_of(F.col(chances), steps).alias(into[0]), draw.alias(drawn))
    copies = F.floor(rate) + F.when(F.col(drawn) < rate - F.floor(rate), 1).otherwise(0)
    return members.select(*kept, rate, copies.cast("long").alias(into[1]))


def fit_mix(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", budget: float = 1.0, keep: tuple[str, ...] = (), into: tuple[str, str] = ("tokens", "chances")
) -> tuple[DataFrame, DomainModel, list[np.ndarray]]:
    """Fits classifier and rates. Returns the members' table (the columns ``keep`` and ``into``), the model and the steps.

    ``labels``: ``key, domain``. ``targets``: the wanted share of tokens by domain, of ``budget`` times all tokens.
    Null and empty texts have no tokens and the priors as chances. Labels with a null key or another domain are
    ignored; a label given twice counts twice. Without rows all rates are 1.
    """
    domains = list(targets)
    share = np.array([targets[d] for d in domains], dtype=float)
    model = fit_domains(documents, labels, domains, key=key, text=text, domain=domain)
    members = cut(memberships(documents.select(*dict.fromkeys((*keep, text))), model, text, into).select(*keep, *into))
    measured = members.select(F.col(into[0]).alias("tokens"), F.col(into[1]).alias("chances"))
    total = measured.agg(F.sum("tokens")).first()[0] or 0
    return members, model, fit_rates(measured, share / share.sum() * total * budget)


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", budget: float = 1.0, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` of every row with ``tokens, chances, rate, copies``; see :func:`fit_mix`.

    All rows stay, also those with 0 copies and repeated ones (which share their verdict); other columns are ignored.
    """
    members, _, steps = fit_mix(documents, labels, targets, key, text, domain, budget, keep)
    return with_rates(members, steps, hash_share(F.col(key).cast("string"), 31))
