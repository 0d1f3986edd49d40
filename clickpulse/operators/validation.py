"""How far the score and its detector can be trusted: resampling, left-out days, injections, weight calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MAD_TO_SIGMA, feature_index, ratio
from ..plans.weights import WEIGHTS
from .anomaly import check_days
from .explore import daily_delta
from .health import Weights, group_scores, health_of, index_rows

TARGETS = ("cart_rate", "session_conversion_rate", "km_median_time_to_cart_s")


def _without(values: Column, n: Column, rank: Column) -> Column:
    """The median of ``n`` sorted values without the one of this rank (from 0); null for one value."""
    other = lambda i: F.get(values, (i + (i >= rank).cast("long")).cast("int"))
    low, high = F.floor((n - 2) / 2), F.floor((n - 1) / 2)
    return F.when(n > 1, (other(low) + other(high)) / 2)


def left_out_bands(daily: DataFrame) -> DataFrame:
    """``feature, date, value, median, sigma``: for each day with a value, the median and robust sigma of all other days of its feature.

    By order statistics. With one day left out, the median of n sorted values can be one of three at most; for each of these the
    deviations are sorted once, and a day's rank among them tells which deviation is in the middle without it. So a
    feature's days are sorted four times and never meet each other; its values are one array (a number per day).
    """
    days = daily.where("value is not null").select("feature", "date", "value")
    by_value = Window.partitionBy("feature").orderBy("value", "date")
    ranked = days.withColumn("rank", F.row_number().over(by_value) - 1)
    sorted_ = days.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a day below, in or above the middle: which of the medians is left without it
    side = sum(((F.floor((F.col("n") - i) / 2) >= F.col("rank")).cast("int") for i in (2, 1)), F.lit(0))
    ranked = ranked.join(sorted_, "feature").select("feature", "date", "value", side.alias("side"), _without(F.col("values"), F.col("n"), F.col("rank")).alias("median"))
    medians = ranked.groupBy("feature", "side").agg(F.first("median").alias("median"))  # three a feature at most
    apart = medians.join(days, "feature").select("feature", "side", "date", F.abs(F.col("value") - F.col("median")).alias("apart"))
    of_side = apart.groupBy("feature", "side").agg(F.sort_array(F.collect_list("apart")).alias("values"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("feature", "side").orderBy("apart", "date")) - 1
    placed = apart.withColumn("rank", place).join(of_side, ["feature", "side"])
    sigma = MAD_TO_SIGMA * _without(F.col("values"), F.col("n"), F.col("rank"))
    return ranked.join(placed.select("feature", "side", "date", sigma.alias("sigma")), ["feature", "side", "date"]).select("feature", "date", "value", "median", "sigma")


def loo_false_positives(daily: DataFrame, ks: tuple[float, ...] = (3.0, 3.5)) -> DataFrame:
    """``feature, k, n_days, false_rate``: how often a day falls out of the band that all other days give. A feature of one day is left out."""
    bands = left_out_bands(daily).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    apart = F.abs(F.col("value") - F.col("median")) > F.col("k") * F.col("sigma")
    return bands.groupBy("feature", "k").agg(F.count(F.lit(1)).alias("n_days"), F.avg(apart.cast("double")).alias("false_rate"))


def draws(spark, resamples: int, n: int) -> DataFrame:
    """``b, i, pick``: ``resamples`` draws of ``n`` numbers below ``n`` with replacement, by hashes that any engine can replay."""
    key = F.concat_ws("-", F.col("b").cast("string"), F.col("i").cast("string"))
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    grid = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("i"))
    return grid.select("b", "i", (number % n).alias("pick"))


def health_bootstrap(health: DataFrame, resamples: int = 1000) -> DataFrame:
    """One row: the median of daily health and its 95 % interval over resampled days: ``median, low, high, width, n_days``."""
    by = Window.partitionBy(F.lit(0)).orderBy("date")  # a row per day
    days = health.where("health is not null").select((F.row_number().over(by) - 1).cast("long").alias("pick"), "health")
    n = days.count()
    medians = draws(health.sparkSession, resamples, n).join(days, "pick").groupBy("b").agg(F.median("health").alias("m"))
    low, high = F.percentile("m", F.lit(0.025)), F.percentile("m", F.lit(0.975))
    return medians.agg(low.alias("low"), high.alias("high"), (high - low).alias("width"), F.lit(n).cast("long").alias("n_days")).withColumn("median", days.agg(F.median("health")).scalar())


SPIKE, STEP, DRIFT = 5.0, 3.0, 5.0


def injection_suite(daily: DataFrame, baseline: DataFrame, state: DataFrame, weights: Weights, day: str, drift_days: int = 10) -> DataFrame:
    """``feature, scenario, n_alerts, first_alert_after, detected, delta_health``: faults put into each feature in turn.

    From ``day`` on: a spike of 5 sigmas for that day, a step of 3 from then on, a drift that grows to 5 in
    ``drift_days``; always in the bad direction. ``delta_health``: the largest fall of a day's score that it causes;
    ``n_alerts``: alerts of the feature from ``day`` on that the clean series doesn't give.
    """
    offset = F.datediff("date", F.lit(day).cast("date"))
    scenarios = F.explode(F.array(*[F.lit(s) for s in ("spike", "step", "drift")]))
    size = (
        F.when((F.col("scenario") == "spike") & (offset == 0), SPIKE)
        .when((F.col("scenario") == "step") & (offset >= 0), STEP)
        .when((F.col("scenario") == "drift") & (offset >= 0), DRIFT * F.least(F.lit(1.0), (offset + 1) / drift_days))
        .otherwise(0.0)
    )
    clean = daily.where(offset >= 0).join(F.broadcast(state.select("feature", "direction", "sigma")), "feature")  # a row per feature
    faulty = clean.withColumn("scenario", scenarios).select("date", "feature", "scenario", F.col("value").alias("was"), (F.col("value") - F.col("direction") * size * F.col("sigma")).alias("value"))
    # a row carries both its values through the check: what was, and what the fault makes of it
    both = F.array(F.struct(F.lit(True).alias("clean"), F.col("was").alias("value")), F.struct(F.lit(False).alias("clean"), F.col("value").alias("value")))
    twice = faulty.select("date", "feature", "scenario", F.explode(both).alias("v")).select("date", "feature", "scenario", "v.*")
    checked = check_days(twice, state, keep=("scenario", "clean")).groupBy("date", "feature", "scenario")
    alerts = checked.agg(F.bool_or(F.col("is_anomaly") & ~F.col("clean")).alias("now"), F.bool_or(F.col("is_anomaly") & F.col("clean")).alias("before")).where("now and not before")
    # one feature changes: the score moves by its part of its group
    index = index_rows(daily.where(offset >= 0), baseline, weights)
    groups = index.groupBy("date", "group").agg(F.count("index_value").alias("used"), F.first("group_weight").alias("gw"))
    total = groups.where("used > 0").groupBy("date").agg(F.sum("gw").alias("total"))
    parts = index.join(groups.drop("gw"), ["date", "group"]).join(total, "date").select("date", "feature", "base_value", "direction", "index_value", ratio(F.col("group_weight") / F.col("total"), F.col("used")).alias("part"))
    moved = faulty.join(parts, ["date", "feature"]).withColumn("delta", F.col("part") * (feature_index(F.col("value"), F.col("base_value"), F.col("direction")) - F.col("index_value")))
    falls = moved.groupBy("feature", "scenario").agg(F.min("delta").alias("delta_health"))
    hits = alerts.groupBy("feature", "scenario").agg(F.count(F.lit(1)).alias("n_alerts"), F.min(offset).cast("long").alias("first_alert_after"))
    n = F.coalesce("n_alerts", F.lit(0))
    return falls.join(hits, ["feature", "scenario"], "left").select("feature", "scenario", n.alias("n_alerts"), "first_alert_after", (n > 0).alias("detected"), "delta_health")


RELATIVE = {"spike": 0.20, "step": 0.10, "drift": 0.01}


def detection_quality(daily: DataFrame, state: DataFrame, day: str, drift_days: int = 10) -> DataFrame:
    """``feature, scenario, n_alerts, n_injected, precision, recall, days_to_detect``: the detector on relative faults.

    From ``day`` on each feature gets worse by 20 % for that day (spike), by 10 % from then on (step), or by 1 % more each day
    for ``drift_days`` (drift). Precision: alerts on injected days over all alerts of the feature from ``day`` on (null without
    alerts); recall: over injected days with a value; ``days_to_detect``: null where none is found.
    """
    offset = F.datediff("date", F.lit(day).cast("date"))
    scenario = F.explode(F.array(*[F.lit(s) for s in RELATIVE]))
    size = (
        F.when((F.col("scenario") == "spike") & (F.col("o") == 0), RELATIVE["spike"])
        .when(F.col("scenario") == "step", RELATIVE["step"])
        .when((F.col("scenario") == "drift") & (F.col("o") < drift_days), RELATIVE["drift"] * (F.col("o") + 1))
        .otherwise(0.0)
    )
    clean = daily.where(offset >= 0).join(F.broadcast(state.drop("version")), "feature")  # a row per feature
    faulty = clean.select("*", offset.alias("o"), scenario.alias("scenario")).withColumn("size", size)
    faulty = faulty.withColumn("value", F.col("value") * (1 - F.col("direction") * F.col("size")))
    center = F.when(F.col("use_dow"), F.element_at("dow_means", F.weekday("date"))).otherwise(F.col("center"))
    residual = F.col("value") - center
    alert = F.coalesce(F.when(F.col("direction") == -1, residual > F.col("hi")).otherwise(residual < F.col("lo")), F.lit(False))
    rows = faulty.select("feature", "scenario", "o", alert.alias("alert"), ((F.col("size") > 0) & F.col("value").isNotNull()).alias("injected"))
    hit = F.col("alert") & F.col("injected")
    found = rows.groupBy("feature", "scenario").agg(F.count_if("alert").alias("n_alerts"), F.count_if("injected").alias("n_injected"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("o"))).cast("long").alias("days_to_detect"))
    return found.select("feature", "scenario", "n_alerts", "n_injected", ratio(F.col("hits"), F.col("n_alerts")).alias("precision"), ratio(F.col("hits"), F.col("n_injected")).alias("recall"), "days_to_detect")


def stress_isolation(daily: DataFrame, baseline: DataFrame, weights: Weights, day: str, feature: str = "dead_search_rate", days: int = 5, worse: float = 0.20) -> DataFrame:
    """``score, mean_delta, n_days``: how each group's score and ``health`` move on average when one feature grows by ``worse``.

    The feature's values are multiplied on ``days`` days from ``day`` on; only these days are compared. Groups without the
    feature should not move.
    """
    inside = daily.where(F.datediff("date", F.lit(day).cast("date")).between(0, days - 1))
    stressed = inside.withColumn("value", F.when(F.col("feature") == feature, F.col("value") * (1 + worse)).otherwise(F.col("value")))

    def scores(rows: DataFrame, name: str) -> DataFrame:
        groups = group_scores(index_rows(rows, baseline, weights))
        parts = groups.select("date", F.col("group").alias("part"), F.col("score").alias(name))
        return parts.unionByName(health_of(groups).select("date", F.lit("health").alias("part"), F.col("health").alias(name)))

    both = scores(inside, "was").join(scores(stressed, "now"), ["date", "part"])
    return both.groupBy(F.col("part").alias("score")).agg(F.avg(F.col("now") - F.col("was")).alias("mean_delta"), F.count(F.col("now") - F.col("was")).alias("n_days"))


def _days_before(days: int) -> Window:
    """The ``days`` days before a row's day, of its feature: a frame of dates, so days without a row take no place."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return Window.partitionBy("feature").orderBy(day).rangeBetween(-days, -1)


def _median(values: Column) -> Column:
    """Of sorted values without nulls; null without any."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def rolling_bands(daily: DataFrame, directions: list[tuple[str, int]], days: int = 7, k: float = 3.5, least: int = 3) -> DataFrame:
    """``date, feature, value, median, sigma, lo, hi, n, is_anomaly``: each day against the median and MAD of the ``days`` before it.

    A detector that follows weekdays and trends by itself, with noisier bands. Days with fewer than ``least`` earlier values
    have no band and don't alert. A day's window is a frame of dates, ``days`` values at most; no day is joined to another.
    """
    direction = F.element_at(F.create_map(*[F.lit(x) for pair in directions for x in pair]), F.col("feature"))
    rows = daily.where(direction.isNotNull()).select("date", "feature", "value").withColumn("past", F.sort_array(F.collect_list("value").over(_days_before(days))))
    rows = rows.withColumn("n", F.size("past").cast("long")).withColumn("median", F.when(F.col("n") >= least, _median(F.col("past"))))
    apart = F.sort_array(F.transform("past", lambda v: F.abs(v - F.col("median"))))
    rows = rows.withColumn("apart", F.when(F.col("median").isNotNull(), apart)).withColumn("sigma", MAD_TO_SIGMA * _median(F.col("apart")))
    rows = rows.withColumns({"lo": F.col("median") - k * F.col("sigma"), "hi": F.col("median") + k * F.col("sigma")})
    alert = F.when(direction == -1, F.col("value") > F.col("hi")).otherwise(F.col("value") < F.col("lo"))
    seen = F.when(F.col("n") >= least, F.col("n")).otherwise(F.lit(0).cast("long"))
    return rows.select("date", "feature", "value", "median", "sigma", "lo", "hi", seen.alias("n"), F.coalesce(alert, F.lit(False)).alias("is_anomaly"))


def baseline_schemes(rows: DataFrame, weights: Weights, start: str, end: str, rolling: tuple[int, ...] = (14, 30), today: DataFrame | None = None) -> DataFrame:
    """``date, scheme, health``: the score against a fixed baseline and against the days just before each day.

    ``rows``: :func:`~.health.feature_rows`. ``today``: other daily values (``date, feature, value``) to score against the same
    baselines. A day's window is a frame of dates: sums over it need no join of days.
    """
    parts = rows.groupBy("date", "feature").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    if today is None:
        today = parts.select("date", "feature", ratio(F.col("above"), F.col("below")).alias("value"))
    past = parts.select(F.col("date").alias("day"), "feature", "above", "below")
    value = ratio(F.sum("above"), F.sum("below")).alias("base_value")
    fixed = past.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("feature").agg(value)
    out = [health_of(group_scores(index_rows(today, fixed, weights))).withColumn("scheme", F.lit("fixed"))]
    named = F.create_map(*[x for w in weights for x in (F.lit(w.feature), F.struct(F.lit(w.group).alias("group"), F.lit(float(w.group_weight)).alias("group_weight"), F.lit(w.direction).alias("direction")))])
    for n in rolling:
        # days to score have no parts of their own, and may have no row among the parts
        asked = today.select("date", "feature", "value", F.lit(True).alias("asked"), *[F.lit(None).cast("double").alias(c) for c in ("above", "below")])
        all_days = parts.select("date", "feature", F.lit(None).cast("double").alias("value"), F.lit(False).alias("asked"), "above", "below").unionByName(asked)
        frame = _days_before(n)
        base = all_days.withColumn("base_value", ratio(F.sum("above").over(frame), F.sum("below").over(frame))).where("asked")
        index = base.select("date", "feature", "value", "base_value").withColumn("w", F.element_at(named, F.col("feature"))).select("date", "feature", "w.*", "value", "base_value")
        index = index.withColumn("index_value", feature_index(F.col("value"), F.col("base_value"), F.col("direction")))
        out.append(health_of(group_scores(index)).withColumn("scheme", F.lit(f"rolling_{n}")))
    return reduce(DataFrame.unionByName, out).select("date", "scheme", "health")


def scheme_spread(rows: DataFrame, daily: DataFrame, state: DataFrame, weights: Weights, start: str, end: str, day: str, feature: str = "cart_per_click", rolling: tuple[int, ...] = (14, 30), sigmas: float = 5.0) -> DataFrame:
    """``scheme, clean_health, injected_health, delta_health, spread``: one spike in the bad direction under each baseline scheme.

    ``spread``: the largest change of health over the smallest; a small one means that the choice of the scheme hardly matters.
    """
    size = state.where(F.col("feature") == feature).select("feature", (F.col("direction") * F.col("sigma") * sigmas).alias("fall"))
    that = daily.where(F.col("date") == F.lit(day).cast("date")).join(F.broadcast(size), "feature", "left")  # one row
    hurt = that.select("date", "feature", (F.col("value") - F.coalesce("fall", F.lit(0.0))).alias("value"))
    clean, injected = (baseline_schemes(rows, weights, start, end, rolling, x).select("scheme", F.col("health").alias(name)) for x, name in ((that.select("date", "feature", "value"), "clean_health"), (hurt, "injected_health")))
    delta = F.col("injected_health") - F.col("clean_health")
    both = clean.join(injected, "scheme").withColumn("delta_health", delta)
    every = Window.partitionBy(F.lit(0))  # a row per scheme
    return both.withColumn("spread", F.max("delta_health").over(every) - F.min("delta_health").over(every))


def weight_set_scores(correlations: DataFrame, candidates: dict[str, dict[str, float]]) -> DataFrame:
    """``candidate, feature, r``, with the candidate's ``mean_r`` and ``min_r``: how a weighted sum of z-scores goes with each feature.

    ``correlations``: :func:`~.explore.feature_correlation`. For weights ``w`` and correlations ``R`` it is
    ``(R w)_i / sqrt(w' R w)``. Pairs without a correlation count as 0.
    """
    spark = correlations.sparkSession
    table = spark.createDataFrame([(c, f, float(x)) for c, ws in candidates.items() for f, x in ws.items()], "candidate string, feature string, w double")
    same = correlations.select(F.col("feature_a").alias("a"), F.col("feature_a").alias("b")).distinct().withColumn("r", F.lit(1.0))
    full = correlations.select(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), F.coalesce("r", F.lit(0.0)).alias("r")).union(same)
    rw = full.join(table.withColumnRenamed("feature", "b"), "b").groupBy("candidate", "a").agg(F.sum(F.col("r") * F.col("w")).alias("rw"))
    own = table.select("candidate", F.col("feature").alias("a"), "w")
    by = Window.partitionBy("candidate")
    rows = rw.join(own, ["candidate", "a"], "left").withColumn("var", F.sum(F.coalesce("w", F.lit(0.0)) * F.col("rw")).over(by))
    rows = rows.withColumn("r", ratio(F.col("rw"), F.sqrt("var")))
    return rows.select("candidate", F.col("a").alias("feature"), "r", F.avg("r").over(by).alias("mean_r"), F.min("r").over(by).alias("min_r"))


def _on_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights that are at least 0 and add up to 1."""
    high = np.sort(w)[::-1]
    over = (np.cumsum(high) - 1) / np.arange(1, len(w) + 1)
    return np.maximum(w - over[np.flatnonzero(high > over)[-1]], 0)


def _ascend(gram: np.ndarray, objective: str, rounds: int = 400) -> np.ndarray:
    """Projected ascent; a step that doesn't gain is halved. The least correlation is approached by ever sharper smooth minima."""

    def value(w: np.ndarray, sharp: float) -> tuple[float, np.ndarray]:
        """The objective of ``gram @ w / sqrt(w' gram w)`` and its gradient."""
        rw = gram @ w
        size = np.sqrt(max(w @ rw, 1e-12))
        r = rw / size
        if objective == "mean":
            share, found = np.full(len(w), 1 / len(w)), r.mean()
        else:
            share = np.exp(-sharp * (r - r.min()))
            found, share = r.min() - np.log(share.mean()) / sharp, share / share.sum()
        return float(found), gram @ share / size - (share @ rw) * rw / size**3

    w = np.full(len(gram), 1 / len(gram))
    for sharp in (10.0, 100.0, 1e3, 1e4, 1e5):
        found, slope = value(w, sharp)
        step = 1.0
        for _ in range(rounds):
            moved = _on_simplex(w + step * slope)
            now, next_slope = value(moved, sharp)
            if now > found:
                w, found, slope, step = moved, now, next_slope, 2 * step
            else:
                step /= 2
                if step < 1e-12:
                    break
    return w


def best_weights(correlations: DataFrame, objectives: tuple[str, ...] = ("mean", "min")) -> DataFrame:
    """``candidate, feature, weight, mean_r, min_r``: the weights whose sum of z-scores goes best with the features.

    ``mean``: with all of them on average; ``min``: with the one that it goes with least. Weights are at least 0 and add up to 1.
    ``correlations``: :func:`~.explore.feature_correlation`, an aggregate over all days with a row per pair of features; only
    that reaches the driver. Both objectives have one maximum where all correlations with the sum are positive. Pairs without
    a correlation count as 0.
    """
    if any(o not in ("mean", "min") for o in objectives):
        raise ValueError("an objective is mean or min")
    pairs = correlations.select("feature_a", "feature_b", F.coalesce("r", F.lit(0.0)).alias("r")).collect()  # features squared, a short list
    names = sorted({p["feature_a"] for p in pairs})
    if not names:
        return correlations.sparkSession.createDataFrame([], "candidate string, feature string, weight double, mean_r double, min_r double")
    gram = np.eye(len(names))
    for p in pairs:
        gram[names.index(p["feature_a"]), names.index(p["feature_b"])] = p["r"]
    found = {o: dict(zip(names, map(float, _ascend(gram, o)), strict=True)) for o in objectives}
    weights = correlations.sparkSession.createDataFrame([(o, f, w) for o, ws in found.items() for f, w in ws.items()], "candidate string, feature string, weight double")
    return weights.join(weight_set_scores(correlations, found).select("candidate", "feature", "mean_r", "min_r"), ["candidate", "feature"])


def _pc1(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    values, vectors = np.linalg.eigh(np.corrcoef(rows.to_numpy(), rowvar=False))
    top = vectors[:, -1] * (-1 if vectors[:, -1].sum() < 0 else 1)
    return top / np.abs(top).sum(), float(values[-1] / values.sum())


def pc1_weights(scores: DataFrame) -> DataFrame:
    """``feature, weight, explained``: loadings of the first principal component of z-scores, with Spark's PCA.

    Signs are turned so that loadings add up to a positive number; weights are their sizes, normalised. Features that
    are null on some day are left out, as are days without them.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    days = scores.select("date").distinct().count()
    names = [r["feature"] for r in scores.where("z is not null").groupBy("feature").count().where(F.col("count") == days).orderBy("feature").collect()]  # features, a short list
    wide = scores.groupBy("date").pivot("feature", names).agg(F.first("z"))
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(wide)
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(vectors).transform(vectors)
    model = PCA(k=1, inputCol="x", outputCol="pc").fit(scaled)
    top = np.array(model.pc.toArray())[:, 0]
    top = -top if top.sum() < 0 else top
    size = np.abs(top) / np.abs(top).sum()
    return scores.sparkSession.createDataFrame([(f, float(w), float(model.explainedVariance[0])) for f, w in zip(names, size, strict=True)], "feature string, weight double, explained double")


def wide_deltas(daily: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """A row per day with the change of each feature and of ``km_speed_to_cart`` (1 / median time); whole days only."""
    speed = daily.where("feature = 'km_median_time_to_cart_s'").select("date", F.lit("km_speed_to_cart").alias("feature"), F.when(F.col("value") > 0, 1 / F.col("value")).alias("value"))
    return daily_delta(daily.unionByName(speed)).groupBy("date").pivot("feature", [*features, "km_speed_to_cart"]).agg(F.first("delta"))


def delta_score(daily: DataFrame, start: str, end: str, alpha: float = 1.0, k: float = 3.0) -> DataFrame:
    """``date, score, lo, hi, is_anomaly``: a diagnostic that sums up a day's changes as they go with changes of the targets.

    Ridge regression of the mean z-score of target changes on z-scores of the other features' changes, fitted within
    ``[start, end]``; the band is ``k`` robust sigmas around the fitted days' median. Not an alert channel.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    features = tuple(w.feature for w in WEIGHTS if w.feature not in TARGETS)
    targets = ("cart_rate", "session_conversion_rate", "km_speed_to_cart")
    wide = wide_deltas(daily, tuple(w.feature for w in WEIGHTS)).select("date", *features, *targets)
    train = wide.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    stats = train.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in (*features, *targets) for f in (F.avg, F.stddev_pop)]).first()
    if not stats["n"]:
        return wide.select("date", *[F.lit(None).cast("double").alias(c) for c in ("score", "lo", "hi")], F.lit(False).alias("is_anomaly"))
    z = {c: (F.col(c) - stats[f"avg_{c}"]) / (stats[f"stddev_pop_{c}"] or 1.0) for c in (*features, *targets)}
    scaled = wide.select("date", *[z[c].alias(c) for c in (*features, *targets)]).withColumn("y", reduce(lambda a, b: a + b, [F.col(t) for t in targets]) / len(targets))
    inside = scaled.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    vectors = VectorAssembler(inputCols=list(features), outputCol="x")
    # Spark divides the penalty by the label's deviation
    penalty = alpha / stats["n"] * (inside.agg(F.stddev_pop("y")).first()[0] or 1.0)
    fit = LinearRegression(featuresCol="x", labelCol="y", elasticNetParam=0.0, regParam=penalty, standardization=False, solver="normal").fit(vectors.transform(inside))
    weights = dict(zip(features, fit.coefficients.toArray(), strict=True))
    score = reduce(lambda a, b: a + b, [F.col(f) * float(w) for f, w in weights.items()])
    rows = scaled.withColumn("score", score)
    signs = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(*[F.corr("score", t).alias(t) for t in targets]).first()
    if sum(s or 0.0 for s in signs) < 0:
        rows = rows.withColumn("score", -F.col("score"))
    fitted = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    middle = fitted.agg(F.median("score")).first()[0]
    sigma = MAD_TO_SIGMA * fitted.agg(F.median(F.abs(F.col("score") - middle))).first()[0]
    lo, hi = middle - k * sigma, middle + k * sigma
    return rows.select("date", "score", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), ((F.col("score") < lo) | (F.col("score") > hi)).alias("is_anomaly"))


def delta_holdout(daily: DataFrame, start: str, end: str, days: int = 14) -> DataFrame:
    """``target, r, n_days``: how the score fitted before goes with each target's change on the last ``days`` days."""
    targets = ("cart_rate", "session_conversion_rate", "km_speed_to_cart")
    last = daily.agg(F.max("date")).scalar()
    scores = delta_score(daily, start, end).select("date", "score").where(F.datediff(last, F.col("date")) < days)
    wide = wide_deltas(daily, tuple(w.feature for w in WEIGHTS)).select("date", *targets)
    both = scores.join(wide, "date")
    return both.agg(*[F.corr("score", t).alias(t) for t in targets], F.count(F.lit(1)).alias("n_days")).unpivot(["n_days"], list(targets), "target", "r").select("target", "r", "n_days")


def ridge_sweep(daily: DataFrame, alphas: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 50.0)) -> DataFrame:
    """``target, alpha, mae, best``: leave-one-out error of ridge fits of each target's changes on the other features'.

    A grid of target and alpha in parallel; each cell holds the days once (a wide row per day) and leaves each out in
    turn. ``best``: the target's alpha with the least error, the smaller of equals.
    """
    features = [w.feature for w in WEIGHTS if w.feature not in TARGETS]
    targets = ["cart_rate", "session_conversion_rate", "km_speed_to_cart"]
    wide = wide_deltas(daily, tuple(w.feature for w in WEIGHTS)).select("date", *features, *targets)
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(float(a)).alias("alpha")) for t in targets for a in alphas]))
    grid = wide.withColumn("cell", cells).select("cell.target", "cell.alpha", "*").drop("cell")

    def errors(part: pd.DataFrame) -> pd.DataFrame:
        target, alpha = part["target"].iloc[0], part["alpha"].iloc[0]
        part = part.sort_values("date")
        x, y = part[features].to_numpy(dtype=float), part[target].to_numpy(dtype=float)
        wrong = []
        for i in range(len(y)):
            rest = np.arange(len(y)) != i
            mean, std = x[rest].mean(0), x[rest].std(0)
            std[std == 0] = 1
            z, middle = (x[rest] - mean) / std, y[rest].mean()
            spread = y[rest].std() or 1.0
            w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ ((y[rest] - middle) / spread))
            wrong.append(abs((x[i] - mean) / std @ w - (y[i] - middle) / spread))
        return pd.DataFrame({"target": [target], "alpha": [alpha], "mae": [float(np.mean(wrong)) if wrong else None]})

    scored = grid.groupBy("target", "alpha").applyInPandas(errors, "target string, alpha double, mae double")
    best = F.min_by("alpha", F.struct("mae", "alpha")).over(Window.partitionBy("target"))
    return scored.withColumn("best", F.col("alpha") == best)


STABILITY = "group string, variant string, feature string, equal double, weight double, loading double, explained double"


def weight_stability(scores: DataFrame, weights: Weights = WEIGHTS, resamples: int = 50) -> DataFrame:
    """``group, variant, feature, equal, weight, loading, explained``: a group's equal and PC1 weights under changes of the data.

    Variants: ``all`` days, bootstrap resamples of days, both halves of time, and without each feature. ``equal``: 1 over the
    number of the group's features; ``loading``: of the first principal component of z-scores, signs turned so that they add
    up to a positive number; ``weight``: sizes of loadings, normalised; ``explained``: the component's part of the variance.
    ``scores``: :func:`~.explore.oriented`. Groups and variants are fitted in parallel; each holds a row per day.
    """
    days = scores.where("z is not null").select("date").distinct()
    by = Window.partitionBy(F.lit(0)).orderBy("date")  # a row per day
    numbered = days.select("date", (F.row_number().over(by) - 1).cast("long").alias("pick"))
    n = days.count()
    groups: dict[str, list[str]] = {}
    for w in weights:
        groups.setdefault(w.group, []).append(w.feature)
    names = [w.feature for w in weights]
    samples = draws(scores.sparkSession, resamples, max(n, 1)).join(numbered, "pick").select(F.concat(F.lit("resample-"), F.col("b").cast("string")).alias("variant"), "date")
    halves = numbered.select(F.when(F.col("pick") < n / 2, "first half").otherwise("second half").alias("variant"), "date")
    without = numbered.select(F.explode(F.array(*[F.lit(f"without {f}") for f in names])).alias("variant"), "date")
    wide = scores.groupBy("date").pivot("feature", names).agg(F.first("z"))
    grid = samples.union(halves).union(without).union(numbered.select(F.lit("all").alias("variant"), "date")).join(wide, "date").withColumn("group", F.explode(F.array(*[F.lit(g) for g in groups])))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        group, variant = part["group"].iloc[0], part["variant"].iloc[0]
        if variant.startswith("without ") and variant[8:] not in groups[group]:
            return pd.DataFrame(columns=[c.split()[0] for c in STABILITY.split(", ")])  # another group's variant
        used = [f for f in groups[group] if f"without {f}" != variant and part[f].notna().all() and part[f].std() > 0]
        if len(used) < 2 or len(part) < 3:
            return pd.DataFrame(columns=[c.split()[0] for c in STABILITY.split(", ")])
        loading, explained = _pc1(part[used])
        return pd.DataFrame({"group": group, "variant": variant, "feature": used, "equal": 1 / len(used), "weight": np.abs(loading), "loading": loading, "explained": explained})

    return grid.groupBy("group", "variant").applyInPandas(fit, STABILITY)


def weight_choice(stability: DataFrame, stable: float = 1.0) -> DataFrame:
    """``group, explained, least_loading, widest_interval, time_split, equal_inside, choice``: one row per group.

    ``widest_interval``: the widest 95 % interval of a weight over resamples, relative to its median; ``time_split``: the largest
    difference of a weight between both halves; ``equal_inside``: all intervals hold the equal weight. ``choice``: ``pc1`` if
    the component explains over half, all loadings are positive and the widest interval is below ``stable``; else ``equal``.
    """
    whole = stability.where("variant = 'all'").groupBy("group").agg(F.first("explained").alias("explained"), F.min("loading").alias("least_loading"))
    drawn = stability.where("variant like 'resample-%'").groupBy("group", "feature").agg(F.percentile("weight", F.lit(0.025)).alias("lo"), F.percentile("weight", F.lit(0.975)).alias("hi"), F.median("weight").alias("mid"), F.first("equal").alias("equal"))
    spread = drawn.groupBy("group").agg(F.max(ratio(F.col("hi") - F.col("lo"), F.col("mid"))).alias("widest_interval"), F.bool_and(F.col("equal").between(F.col("lo"), F.col("hi"))).alias("equal_inside"))
    half = lambda v: F.max(F.when(F.col("variant") == v, F.col("weight")))
    halves = stability.groupBy("group", "feature").agg((half("first half") - half("second half")).alias("d")).groupBy("group").agg(F.max(F.abs("d")).alias("time_split"))
    rows = whole.join(spread, "group", "left").join(halves, "group", "left")
    pc1 = (F.col("explained") > 0.5) & (F.col("least_loading") > 0) & (F.col("widest_interval") < stable)
    return rows.select("group", "explained", "least_loading", "widest_interval", "time_split", "equal_inside", F.when(pc1, "pc1").otherwise("equal").alias("choice"))
