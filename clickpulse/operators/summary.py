"""Sessions rolled up by day and category, with a Kaplan-Meier median of the time to cart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..sources.events import optional_column

MIN_CATEGORY_SESSIONS = 2000
KM_MIN_EVENTS = 30
OTHER = "other"


def fold_categories(sessions: DataFrame, min_sessions: int = MIN_CATEGORY_SESSIONS) -> DataFrame:
    """Adds ``date`` (the day of ``ts_end``) and ``category``: the modal one if frequent enough over all days, else ``other``.

    The list of frequent categories is joined, not collected; it is counted from two narrow columns.
    """
    rows = sessions.withColumn("date", F.to_date("ts_end")).withColumn("_raw", F.coalesce(optional_column(sessions, "top_category_in_session", F.lit(None).cast("string")), F.lit(OTHER)))
    large = rows.groupBy("_raw").count().where(F.col("count") >= min_sessions).select("_raw", F.lit(True).alias("_large"))
    return rows.join(large, "_raw", "left").withColumn("category", F.when(F.col("_large"), F.col("_raw")).otherwise(OTHER)).drop("_raw", "_large")


def km_median(sessions: DataFrame, keys: tuple[str, ...] = ("date", "category"), min_events: int = KM_MIN_EVENTS) -> DataFrame:
    """``keys, km_median_time_to_cart_s``: the first time at which half of the sessions have reached the cart.

    A converted session ends at its cart, others are censored at their length; those that end together leave the risk
    set together. Null with fewer than ``min_events`` conversions or a curve that stays above a half. Sessions are
    counted by duration first, so the windows run over distinct seconds.
    """
    time = F.when(F.col("reached_cart"), F.col("time_to_cart_s")).otherwise(F.col("duration_s"))
    steps = sessions.groupBy(*keys, time.alias("t")).agg(F.count_if("reached_cart").alias("d"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumn("risk", F.sum("n").over(later)).withColumn("alive", F.product(1 - F.col("d") / F.col("risk")).over(upto))
    half = F.min(F.when((F.col("alive") <= 0.5) & (F.col("d") > 0), F.col("t")))
    return curve.groupBy(*keys).agg(F.when(F.sum("d") >= min_events, half).cast("double").alias("km_median_time_to_cart_s"))


def day_summary(sessions: DataFrame, min_category_sessions: int = MIN_CATEGORY_SESSIONS, km_min_events: int = KM_MIN_EVENTS) -> DataFrame:
    """One row per day and category with all measures; one grouped plan over all days."""
    rows = fold_categories(sessions, min_category_sessions).withColumn("n_unique_categories", optional_column(sessions, "n_unique_categories", F.lit(0)))
    share = lambda condition: F.avg(condition.cast("double"))
    carted = lambda column: F.avg(F.when(F.col("reached_cart"), F.col(column)))
    total = lambda column: F.sum(column)
    summary = rows.groupBy("date", "category").agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg("n_events").alias("rate_events"),
        F.avg("n_search").alias("rate_searches"),
        F.avg("n_view").alias("rate_views"),
        F.avg("n_click").alias("rate_clicks"),
        F.avg("n_fav").alias("rate_favs"),
        F.avg("n_unique_queries").alias("rate_unique_queries"),
        F.count_if("reached_cart").alias("is_cart"),
        F.avg("n_cart").alias("cart_rate"),
        share(F.col("reached_cart")).alias("session_conversion_rate"),
        share(F.col("n_events") == 1).alias("bounce_rate"),
        share(F.col("n_click") == 0).alias("dead_search_rate"),
        share(F.col("n_unique_queries") > 1).alias("search_refinement_rate"),
        F.avg("duration_s").alias("mean_duration_s"),
        share(F.col("n_unique_categories") > 1).alias("multi_category_rate"),
        ratio(total("n_view"), total("n_search")).alias("view_per_search"),
        ratio(total("n_click"), total("n_view")).alias("click_per_view"),
        ratio(total("n_cart"), total("n_click")).alias("cart_per_click"),
        carted("n_search").alias("mean_searches_to_cart"),
        carted("n_unique_queries").alias("mean_unique_queries_to_cart"),
        carted("time_to_cart_s").alias("mean_time_to_cart_s"),
    )
    return summary.join(km_median(rows, min_events=km_min_events), ["date", "category"], "left")
