"""The registered queries: each operator over the driver's whole tables. Doubles are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_query
from ..operators import anomaly, enrich, explore, health, rca, segments, sessions, summary, validation
from .tables import SHOP, Analysis
from .weights import WEIGHTS, directions

Query = Callable[[SparkSession, str], DataFrame]
START, END = SHOP.baseline
DAY_FROM, DAY = "2024-01-20", "2024-01-25"
INJECT_FROM = "2024-01-21"
BORDER, AFTER_BORDER = "2024-01-15", "2024-01-16"
ALERT_DAY = "2024-01-01"
CATEGORY = "LARGE"
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates and timestamps as text, small integers as longs: values that any engine prints alike."""

    def cast(name: str, kind: str):
        c = F.col(name)
        if kind == "double":
            return F.round(c, 6).alias(name)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind in ("int", "tinyint", "smallint"):
            return c.cast("long").alias(name)
        return c

    return df.select(*[cast(n, k) for n, k in df.dtypes])


def query(function: Callable[[Analysis], DataFrame]) -> Callable[[Analysis], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: plain(function(Analysis.of_shop(spark, sf_dir)))
    return function


# sources and sessions


@query
def scan_events(a: Analysis) -> DataFrame:
    from ..sources.events import date_range

    rows = date_range(a.events, "2024-01-05", "2024-01-12").select("user_id", "date", "timestamp", "action_type", "widget_name", "search_query", "item_id")
    return rows.groupBy("date", "action_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.count("search_query").alias("n_queries"), F.sum("item_id").alias("items"))


@query
def session_gaps(a: Analysis) -> DataFrame:
    return sessions.number_sessions(a.events, SHOP.gap_min).select("event_id", "user_id", "gap_s", "session_idx")


@query
def chunked_sessions(a: Analysis) -> DataFrame:
    built = sessions.build_sessions(a.events, a.products, SHOP.gap_min, chunk_days=1)
    return built.select("user_id", "chunk_start", "session_idx", "n_events", "n_search", "duration_s", "reached_cart")


@query
def sessionize(a: Analysis) -> DataFrame:
    return a.sessions


@query
def sessions_in_two_runs(a: Analysis) -> DataFrame:
    """The first half of the days and then the rest, each read once, with sessions that go on over the border."""
    from ..sources.events import date_range
    from ..sources.folders import shared_folder
    from .store import RunStore

    store = RunStore(a.events.sparkSession, shared_folder(a.events.sparkSession))
    for days in ((None, BORDER), (AFTER_BORDER, None)):
        store.append(date_range(a.events, *days), a.products, tables=False)
    return store.sessions().drop("date")


def user_log(a: Analysis):
    """The log laid out by user, appended in two parts."""
    from ..sources.events import date_range
    from ..sources.folders import shared_folder
    from .user_log import UserLog

    log = UserLog(a.events.sparkSession, shared_folder(a.events.sparkSession))
    for days in ((None, BORDER), (AFTER_BORDER, None)):
        log.append(date_range(a.events, *days))
    return log


@query
def user_log_sessions(a: Analysis) -> DataFrame:
    return user_log(a).sessions(a.products, SHOP.gap_min)


@query
def user_log_gaps(a: Analysis) -> DataFrame:
    return user_log(a).number_sessions(SHOP.gap_min).select("event_id", "user_id", "gap_s", "session_idx")


@query
def user_log_gap_histogram(a: Analysis) -> DataFrame:
    return user_log(a).gap_histogram()


@query
def session_invariants(a: Analysis) -> DataFrame:
    return sessions.session_violations(a.sessions)


@query
def gap_histogram(a: Analysis) -> DataFrame:
    return sessions.gap_histogram(a.events)


@query
def gap_valleys(a: Analysis) -> DataFrame:
    return sessions.gap_valleys(sessions.gap_histogram(a.events))


@query
def conversion_ci(a: Analysis) -> DataFrame:
    return sessions.conversion_interval(a.sessions)


# enrichment


@query
def normalize_queries(a: Analysis) -> DataFrame:
    return a.events.where("search_query is not null").select("event_id", normalize_query(F.col("search_query")).alias("query_clean"))


@query
def catalog_texts(a: Analysis) -> DataFrame:
    return enrich.catalog_texts(a.products)


@query
def catalog_articles(a: Analysis) -> DataFrame:
    return enrich.catalog_articles(a.products)


@query
def enrich_sessions(a: Analysis) -> DataFrame:
    return a.enriched.select("user_id", "session_idx", *enrich.ENRICHED)


@query
def enriched_contract(a: Analysis) -> DataFrame:
    return enrich.enriched_contract(a.enriched)


@query
def verify_enriched(a: Analysis) -> DataFrame:
    """Against a copy in which queries of even users lost their last character."""
    changed = a.kept_sessions.withColumn("first_query", F.when(F.col("user_id") % 2 == 0, F.expr("left(first_query, length(first_query) - 1)")).otherwise(F.col("first_query")))
    return enrich.verify_against(enrich.enrich_sessions(a.kept_sessions, a.products), enrich.enrich_sessions(changed, a.products))


@query
def segment_labels(a: Analysis) -> DataFrame:
    return a.enriched.select("user_id", "session_idx", *[segments.segment_value(a.enriched, s).alias(f"seg_{s}") for s in segments.SEGMENTS])


# day summary


@query
def category_fold(a: Analysis) -> DataFrame:
    return summary.fold_categories(a.kept_sessions, SHOP.min_category_sessions).groupBy("category").agg(F.count(F.lit(1)).alias("n_sessions"), F.count_distinct("date").alias("n_days"))


@query
def km_median(a: Analysis) -> DataFrame:
    return summary.km_median(summary.fold_categories(a.kept_sessions, SHOP.min_category_sessions), min_events=SHOP.km_min_events)


@query
def day_summary(a: Analysis) -> DataFrame:
    return a.summary


@query
def daily_features(a: Analysis) -> DataFrame:
    return a.daily


@query
def daily_delta(a: Analysis) -> DataFrame:
    return explore.daily_delta(a.daily)


@query
def baseline_window(a: Analysis) -> DataFrame:
    return health.baseline_window(a.summary, 20)


# health


@query
def health_daily(a: Analysis) -> DataFrame:
    return a.health


@query
def health_default_baseline(a: Analysis) -> DataFrame:
    """Against the first 20 days with data, found from the summary."""
    return Analysis(a.events, a.products, replace(SHOP, baseline=None, baseline_days=20)).health


@query
def health_indices(a: Analysis) -> DataFrame:
    return a.indices


@query
def health_stratified(a: Analysis) -> DataFrame:
    return a.categories


@query
def daily_metrics(a: Analysis) -> DataFrame:
    return a.metrics


# detector


@query
def mad_thresholds(a: Analysis) -> DataFrame:
    return a.detector.select("feature", "direction", "use_dow", "center", "median", "mad", "sigma", "lo", "hi", "n")


@query
def detector_state(a: Analysis) -> DataFrame:
    """Weekday means of the state, a row each."""
    return a.detector.select("version", "feature", "k", F.explode("dow_means").alias("dow", "dow_mean"))


@query
def mad_alerts(a: Analysis) -> DataFrame:
    return a.checked


@query
def mad_same_dow(a: Analysis) -> DataFrame:
    return anomaly.same_weekday_bands(a.daily, SHOP.mad_k)


# explanation


@query
def decomposition(a: Analysis) -> DataFrame:
    return a.decomposition


@query
def decomposition_check(a: Analysis) -> DataFrame:
    return rca.additivity_violations(a.decomposition, a.health)


@query
def top_contributors(a: Analysis) -> DataFrame:
    return rca.top_contributors(a.decomposition, DAY).select("group", "feature", "index_value", "contribution")


@query
def explain_delta(a: Analysis) -> DataFrame:
    return rca.explain_drop(a.decomposition, DAY_FROM, DAY)


@query
def anomaly_summary(a: Analysis) -> DataFrame:
    return rca.anomalies_of(a.decomposition, ALERT_DAY).select("feature", "today_value", "residual", "sigma", "corridor_lo", "corridor_hi")


@query
def category_drilldown(a: Analysis) -> DataFrame:
    return rca.category_of(a.decomposition, DAY, CATEGORY)


@query
def day_view(a: Analysis) -> DataFrame:
    return rca.day_view(a.decomposition, DAY).select("level", "group", "feature", "category", "index_value", "contribution", "residual_sigmas", "included", "skip_reason")


@query
def worst_categories(a: Analysis) -> DataFrame:
    return rca.worst_categories(a.decomposition, DAY).select("category", "index_value", "contribution", "n_sessions_today")


TIMELINE = ("date", "health", "stratified", "drift", "band", "n_sessions", "n_anomalies_active", "has_alert")


@query
def timeline(a: Analysis) -> DataFrame:
    return rca.timeline(a.metrics.select(*TIMELINE), "2024-01-10", "2024-01-24")


@query
def timeline_kpis(a: Analysis) -> DataFrame:
    return rca.timeline_kpis(a.metrics, health.baseline_window(a.summary, 20))


@query
def anomaly_days(a: Analysis) -> DataFrame:
    return rca.anomaly_days(a.metrics).select("date", "health", "n_anomalies_active", "alert_features")


# segments


@query
def segment_breakdown(a: Analysis) -> DataFrame:
    return a.breakdown


@query
def segments_view(a: Analysis) -> DataFrame:
    return segments.segments_view(a.breakdown, segment="query_len_bucket").select("segment", "value", "n_sessions", "success_rate", "share")


@query
def weak_spots(a: Analysis) -> DataFrame:
    return segments.weak_spots(a.breakdown, SHOP.min_volume_period, SHOP.min_lift).select("segment", "value", "n_sessions", "success_rate", "lift_vs_overall", "failure_volume")


@query
def weak_spot_totals(a: Analysis) -> DataFrame:
    return segments.weak_spot_totals(segments.weak_spots(a.breakdown, SHOP.min_volume_period, SHOP.min_lift))


@query
def segment_day_view(a: Analysis) -> DataFrame:
    view = segments.segment_day_view(a.breakdown, DAY, SHOP.baseline, SHOP.min_volume_day)
    return view.select("segment", "value", "n_sessions", "success_rate", "success_rate_period", "n_sessions_period", "delta_vs_period", "extra_failures", "norm_source")


@query
def example_failures(a: Analysis) -> DataFrame:
    return segments.example_failures(a.enriched, "first_widget", "web_search_bar")


# exploration


@query
def quantile_profile(a: Analysis) -> DataFrame:
    return explore.quantile_profile(a.enriched, ("n_events", "n_search", "n_unique_queries", "query_len_words"))


@query
def score_histogram(a: Analysis) -> DataFrame:
    return explore.score_histogram(a.enriched, "query_stratification_score")


@query
def outcome_by_score(a: Analysis) -> DataFrame:
    return explore.outcome_by_score(a.enriched)


@query
def score_corr(a: Analysis) -> DataFrame:
    return explore.score_correlation(a.enriched)


@query
def feature_corr(a: Analysis) -> DataFrame:
    return explore.feature_correlation(explore.oriented(a.daily, directions()))


@query
def mde_table(a: Analysis) -> DataFrame:
    return explore.mde_table(a.summary)


@query
def lead_lag_corr(a: Analysis) -> DataFrame:
    kpi = a.daily.where("feature = 'session_conversion_rate'").select("date", F.col("value").alias("kpi"))
    return explore.lead_lag(a.health, kpi)


# validation


@query
def mad_loo_fp(a: Analysis) -> DataFrame:
    return validation.loo_false_positives(a.daily)


@query
def health_bootstrap(a: Analysis) -> DataFrame:
    return validation.health_bootstrap(a.health.select("date", F.round("health", 6).alias("health")))


@query
def injection_suite(a: Analysis) -> DataFrame:
    return validation.injection_suite(a.daily, a.base_values, a.detector, SHOP.weights, INJECT_FROM)


@query
def baseline_schemes(a: Analysis) -> DataFrame:
    return validation.baseline_schemes(a.features, SHOP.weights, START, END)


@query
def scheme_spread(a: Analysis) -> DataFrame:
    return validation.scheme_spread(a.features, a.daily, a.detector, SHOP.weights, START, END, DAY)


@query
def stress_isolation(a: Analysis) -> DataFrame:
    return validation.stress_isolation(a.daily, a.base_values, SHOP.weights, INJECT_FROM)


@query
def detection_quality(a: Analysis) -> DataFrame:
    return validation.detection_quality(a.daily, a.detector, INJECT_FROM)


@query
def rolling_mad(a: Analysis) -> DataFrame:
    return validation.rolling_bands(a.daily, directions())


def candidates() -> dict[str, dict[str, float]]:
    """Weight sets to compare: all features alike, groups alike, and the score's own."""
    sizes = {g: sum(w.group == g for w in WEIGHTS) for g in {w.group for w in WEIGHTS}}
    return {
        "equal": {w.feature: 1 / len(WEIGHTS) for w in WEIGHTS},
        "groups": {w.feature: 1 / len(sizes) / sizes[w.group] for w in WEIGHTS},
        "score": {w.feature: w.group_weight / sizes[w.group] for w in WEIGHTS},
    }


@query
def weight_set_scores(a: Analysis) -> DataFrame:
    return validation.weight_set_scores(explore.feature_correlation(explore.oriented(a.daily, directions())), candidates())


@query
def best_weights(a: Analysis) -> DataFrame:
    return validation.best_weights(explore.feature_correlation(explore.oriented(a.daily, directions())))


@query
def pc1_weights(a: Analysis) -> DataFrame:
    return validation.pc1_weights(explore.oriented(a.daily, directions()))


@query
def delta_score(a: Analysis) -> DataFrame:
    return validation.delta_score(a.daily, START, END)


@query
def delta_holdout(a: Analysis) -> DataFrame:
    return validation.delta_holdout(a.daily, START, "2024-01-16")


@query
def ridge_sweep(a: Analysis) -> DataFrame:
    return validation.ridge_sweep(a.daily)


@query
def weight_stability(a: Analysis) -> DataFrame:
    return validation.weight_stability(explore.oriented(a.daily, directions()))


@query
def weight_choice(a: Analysis) -> DataFrame:
    return validation.weight_choice(validation.weight_stability(explore.oriented(a.daily, directions())))
