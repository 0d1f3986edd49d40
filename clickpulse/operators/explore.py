"""Exploration: profiles, histograms, correlations, detectable effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import detectable_effect, ratio


def quantile_profile(sessions: DataFrame, columns: tuple[str, ...], quantiles: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """``column, q90, q95, ..., max`` with discrete quantiles: values that occur. One aggregate over all columns."""
    names = [f"q{q * 100:g}" for q in quantiles]

    def found(c: str) -> Column:
        each = [F.expr(f"percentile_disc({q}) within group (order by cast(`{c}` as double))").alias(n) for q, n in zip(quantiles, names, strict=True)]
        return F.struct(F.lit(c).alias("column"), *each, F.max(F.col(c).cast("double")).alias("max"))

    return sessions.agg(F.array(*[found(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def score_histogram(df: DataFrame, column: str) -> DataFrame:
    """``value, n, percent`` of all rows; nulls are a value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))  # a row per value


def outcome_by_score(enriched: DataFrame) -> DataFrame:
    score = F.col("query_stratification_score").cast("long").alias("score")
    return enriched.groupBy(score).agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("n_cart").alias("mean_n_cart"), F.avg(F.col("reached_cart").cast("double")).alias("cart_rate"))


def score_correlation(enriched: DataFrame) -> DataFrame:
    score = F.col("query_stratification_score").cast("double")
    return enriched.agg(F.corr(score, F.col("n_cart").cast("double")).alias("corr_score_n_cart"), F.corr(score, F.col("reached_cart").cast("double")).alias("corr_score_reached_cart"))


def oriented(daily: DataFrame, directions: list[tuple[str, int]]) -> DataFrame:
    """``date, feature, z``: daily features turned so that more is better, as population z-scores; null if constant."""
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in directions for x in pair]), F.col("feature"))
    rows = daily.withColumn("x", F.col("value") * sign).where(sign.isNotNull())
    w = Window.partitionBy("feature")
    z = ratio(F.col("x") - F.avg("x").over(w), F.stddev_pop("x").over(w))
    return rows.select("date", "feature", z.alias("z"))


def feature_correlation(scores: DataFrame) -> DataFrame:
    """``feature_a, feature_b, r, negative`` for every ordered pair of different features, over days that have both."""
    a = scores.select("date", F.col("feature").alias("feature_a"), F.col("z").alias("a"))
    b = scores.select("date", F.col("feature").alias("feature_b"), F.col("z").alias("b"))
    pairs = a.join(b, "date").where("feature_a <> feature_b and a is not null and b is not null")
    return pairs.groupBy("feature_a", "feature_b").agg(F.corr("a", "b").alias("r")).withColumn("negative", F.col("r") < 0)


def mde_table(summary: DataFrame) -> DataFrame:
    """``segment, n, p, mde, mde_percent`` of conversion, for each category and ``ALL``."""
    sums = summary.rollup("category").agg(F.sum("n_sessions").alias("n"), F.sum("is_cart").alias("c"), F.grouping("category").alias("_all"))
    p = ratio(F.col("c"), F.col("n"))
    rows = sums.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("segment"), "n", p.alias("p"))
    effect = detectable_effect(F.col("p"), F.col("n"))
    return rows.withColumn("mde", effect).withColumn("mde_percent", 100 * ratio(effect, F.col("p")))


def daily_delta(daily: DataFrame) -> DataFrame:
    """``date, feature, delta`` to the day before that has data; days where any feature's delta is null are dropped."""
    by = Window.partitionBy("feature").orderBy("date")
    rows = daily.withColumn("delta", F.col("value") - F.lag("value").over(by))
    whole = F.count_if(F.col("delta").isNull()).over(Window.partitionBy("date")) == 0
    return rows.withColumn("_whole", whole).where("_whole").select("date", "feature", "delta")


def lead_lag(health: DataFrame, kpi: DataFrame, leads: int = 3) -> DataFrame:
    """``lead, r``: how changes of health go with changes of a KPI ``lead`` days later; both are ``date`` tables of days."""
    by = Window.partitionBy(F.lit(0)).orderBy("date")  # a row per day
    rows = health.select("date", "health").join(kpi.select("date", "kpi"), "date")
    rows = rows.withColumn("dh", F.col("health") - F.lag("health").over(by)).withColumn("dk", F.col("kpi") - F.lag("kpi").over(by))
    for k in range(leads + 1):
        rows = rows.withColumn(f"k{k}", F.lead("dk", k).over(by))
    return rows.agg(*[F.corr("dh", f"k{k}").alias(str(k)) for k in range(leads + 1)]).unpivot([], [str(k) for k in range(leads + 1)], "lead", "r").withColumn("lead", F.col("lead").cast("long"))
