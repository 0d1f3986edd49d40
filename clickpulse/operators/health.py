"""The health score: features against a baseline, grouped, weighted, and with the category mix held fixed."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import feature_index, health_band, no_nan, ratio
from ..plans.weights import FEATURES, GROUPS, FeatureWeight

Weights = tuple[FeatureWeight, ...]

MIN_SESSIONS_PER_CATEGORY = 100
BASELINE_DAYS = 30
TO_CART = ("mean_searches_to_cart", "mean_unique_queries_to_cart", "mean_time_to_cart_s")


def warn_absent(summary: DataFrame, features: tuple[str, ...]) -> list[str]:
    """Features that the day summary lacks; a warning names them, as a misspelt one would count for nothing unnoticed."""
    absent = [f for f in features if f not in summary.columns]
    if absent:
        warnings.warn(f"the day summary lacks features, which are left out: {absent}", stacklevel=3)
    return absent


def feature_rows(summary: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``date, category, feature, above, below, n_sessions``: the day summary unpivoted into weighted parts.

    A feature of any set of rows is ``sum(above) / sum(below)``: values weighted by sessions where they aren't null.
    Conversion is carts over sessions. Features that the summary lacks are left out, with a warning that names them.
    """
    warn_absent(summary, features)
    present = [f for f in features if f in summary.columns]
    rows = summary.select("date", "category", "n_sessions", "is_cart", *[no_nan(F.col(f)).alias(f) for f in present]).unpivot(["date", "category", "n_sessions", "is_cart"], present, "feature", "value")
    conversion = F.col("feature") == "session_conversion_rate"
    above = F.when(conversion, F.col("is_cart").cast("double")).otherwise(F.col("value") * F.col("n_sessions"))
    below = F.when(conversion | F.col("value").isNotNull(), F.col("n_sessions").cast("double"))
    return rows.select("date", "category", "feature", above.alias("above"), below.alias("below"), "n_sessions")


def _value() -> Column:
    return ratio(F.sum("above"), F.sum("below"))


def daily_features(rows: DataFrame) -> DataFrame:
    """``date, feature, value`` over all categories of a day."""
    return rows.groupBy("date", "feature").agg(_value().alias("value"))


def baseline_window(summary: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """The default baseline, from the first date on: ``baseline_start, baseline_end, n_days`` (days that have data)."""
    first = summary.agg(F.min("date")).scalar()
    inside = summary.where(F.col("date").between(first, F.date_add(first, days - 1)))
    return inside.agg(F.min("date").alias("baseline_start"), F.date_add(F.min("date"), days - 1).alias("baseline_end"), F.count_distinct("date").alias("n_days"))


def default_baseline(summary: DataFrame, days: int = BASELINE_DAYS) -> tuple[str, str]:
    """First and last day of :func:`baseline_window` as text; an error if the summary is empty."""
    first = summary.agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("a"), F.date_format(F.date_add(F.min("date"), days - 1), "yyyy-MM-dd").alias("z")).first()
    if first is None or first["a"] is None:
        raise ValueError("the day summary is empty")
    return first["a"], first["z"]


def within(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the baseline, both ends included."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def index_rows(today: DataFrame, baseline: DataFrame, weights: Weights, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every weighted feature of every day (and of ``keys``), with its value, its baseline and its index.

    ``today``: ``date, *keys, feature, value``; ``baseline``: ``*keys, feature, base_value``. Features that a day lacks
    have a null value.
    """
    days = today.select("date", *keys).distinct()
    named = [F.struct(F.lit(w.group).alias("group"), F.lit(float(w.group_weight)).alias("group_weight"), F.lit(w.feature).alias("feature"), F.lit(w.direction).alias("direction")) for w in weights]
    grid = days.withColumn("w", F.explode(F.array(*named))).select("date", *keys, "w.*")
    return (
        grid.join(today, ["date", *keys, "feature"], "left")
        .join(baseline, [*keys, "feature"], "left")
        .withColumn("index_value", feature_index(F.col("value"), F.col("base_value"), F.col("direction")))
    )


def group_scores(indices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``date, *keys, group, group_weight, score, n_used``: the plain mean of a group's indices that aren't null."""
    return indices.groupBy("date", *keys, "group", "group_weight").agg(F.avg("index_value").alias("score"), F.count("index_value").alias("n_used"))


def health_of(groups: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``date, *keys, health``: the weighted mean of groups that have a score."""
    weight = F.when(F.col("score").isNotNull(), F.col("group_weight"))
    return groups.groupBy("date", *keys).agg(ratio(F.sum(weight * F.col("score")), F.sum(weight)).alias("health"))


def day_indices(summary: DataFrame, weights: Weights, start: str, end: str) -> DataFrame:
    """:func:`index_rows` of whole days; the baseline is weighted by sessions over all its rows."""
    rows = feature_rows(summary)
    base = within(rows, start, end).groupBy("feature").agg(_value().alias("base_value"))
    return index_rows(daily_features(rows), base, weights)


def category_health(summary: DataFrame, weights: Weights, start: str, end: str, min_sessions: int = MIN_SESSIONS_PER_CATEGORY) -> DataFrame:
    """Every baseline category on every day: its health, weights, and whether it counts.

    ``date, category, base_weight, today_share, n_sessions_today, health, included, skip_reason``. Categories are
    skipped as ``missing_today``, ``low_volume`` or ``nan_health``; those that the baseline lacks don't appear.
    """
    rows = feature_rows(summary)
    keys = ("category",)
    today = rows.groupBy("date", "category", "feature").agg(_value().alias("value"))
    base = within(rows, start, end).groupBy("category", "feature").agg(_value().alias("base_value"))
    health = health_of(group_scores(index_rows(today, base, weights, keys), keys), keys)
    share = within(summary, start, end).groupBy("category").agg(F.sum("n_sessions").alias("n"))
    share = share.select("category", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("base_weight"))  # a row per category
    sizes = summary.groupBy("date", "category").agg(F.sum("n_sessions").alias("n_sessions_today"))
    totals = summary.groupBy("date").agg(F.sum("n_sessions").alias("n_day"))
    # the baseline's categories (frequent ones and "other") as one array, laid out for each day
    listed = share.agg(F.collect_list(F.struct("category", "base_weight"))).scalar()
    grid = totals.withColumn("c", F.explode(listed)).select("date", "n_day", "c.*")
    joined = grid.join(sizes, ["date", "category"], "left").join(health, ["date", "category"], "left")
    n = F.col("n_sessions_today")
    reason = F.when(n.isNull(), "missing_today").when(n < min_sessions, "low_volume").when(F.col("health").isNull(), "nan_health")
    return joined.select(
        "date",
        "category",
        "base_weight",
        F.coalesce(ratio(n, F.col("n_day")), F.lit(0.0)).alias("today_share"),
        F.coalesce(n, F.lit(0)).alias("n_sessions_today"),
        F.when(n.isNotNull(), F.col("health")).alias("health"),
        reason.isNull().alias("included"),
        reason.alias("skip_reason"),
    )


def stratified(categories: DataFrame) -> DataFrame:
    """``date, stratified``: included categories weighted by their baseline share."""
    weight = F.when(F.col("included"), F.col("base_weight"))
    return categories.groupBy("date").agg(ratio(F.sum(weight * F.col("health")), F.sum(weight)).alias("stratified"))


def daily_health(summary: DataFrame, weights: Weights, start: str, end: str, min_sessions: int = MIN_SESSIONS_PER_CATEGORY) -> DataFrame:
    """``date, health, stratified, drift`` for every day; drift is stratified minus raw."""
    raw = health_of(group_scores(day_indices(summary, weights, start, end)))
    mixed = stratified(category_health(summary, weights, start, end, min_sessions))
    return raw.join(mixed, "date", "left").withColumn("drift", F.col("stratified") - F.col("health"))


def day_totals(summary: DataFrame) -> DataFrame:
    """Sums of a day, and the to-cart means weighted by all its sessions. Users count once per category."""
    n = F.col("n_sessions")
    means = [ratio(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n))).alias(c) for c in TO_CART]
    return summary.groupBy("date").agg(F.sum("n_sessions").alias("n_sessions"), F.sum("n_users").alias("n_users"), F.sum("is_cart").alias("converted_sessions"), *means)


def daily_metrics(summary: DataFrame, indices: DataFrame, health: DataFrame, alerts: DataFrame, start: str, end: str) -> DataFrame:
    """One wide row per day: scores, totals, active alerts, and ``group_*`` and ``feature_*`` columns.

    ``indices``: :func:`day_indices`; ``health``: :func:`daily_health`; ``alerts``: ``date, feature, is_anomaly``. Pivots name their values, so no pass over the data finds them.
    """
    groups = group_scores(indices).groupBy("date").pivot("group", list(GROUPS)).agg(F.first("score"))
    features = indices.groupBy("date").pivot("feature", list(FEATURES)).agg(F.first("index_value"))
    active = alerts.where("is_anomaly").groupBy("date").agg(F.count(F.lit(1)).alias("n_anomalies_active"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("alert_features"))
    n = F.coalesce("n_anomalies_active", F.lit(0))
    return (
        health.join(day_totals(summary), "date")
        .join(active, "date", "left")
        .join(groups.select("date", *[F.col(g).alias(f"group_{g}") for g in GROUPS]), "date", "left")
        .join(features.select("date", *[F.col(f).alias(f"feature_{f}") for f in FEATURES]), "date", "left")
        .withColumn("n_anomalies_active", n)
        .withColumn("alert_features", F.coalesce("alert_features", F.lit("")))
        .withColumn("has_alert", F.col("n_anomalies_active") > 0)
        .withColumn("band", health_band(F.col("health")))
        .withColumn("baseline_start", F.lit(start))
        .withColumn("baseline_end", F.lit(end))
    )
