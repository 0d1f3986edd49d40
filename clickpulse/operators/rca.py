"""Why a score is what it is: additive parts, and what changed between two days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio

#: The output's columns, in order.
COLUMNS = {
    "date": "date", "level": "string", "group": "string", "feature": "string", "category": "string",
    "today_value": "double", "baseline_value": "double", "direction": "int", "index_value": "double", "contribution": "double",
    "is_anomaly": "boolean", "dow_used": "boolean", "residual": "double", "sigma": "double", "corridor_lo": "double", "corridor_hi": "double",
    "n_sessions_today": "long", "base_weight": "double", "today_share": "double", "included": "boolean", "skip_reason": "string",
}
ORDER = ("date", "level", "group", "feature", "category")


def decompose(indices: DataFrame, checked: DataFrame, categories: DataFrame) -> DataFrame:
    """All days' scores as sums of parts, in long form (``COLUMNS``).

    Group parts and feature parts of a day each add up to its raw score, parts of included categories to its
    stratified score. Features without an index, and skipped categories, keep a row without a contribution.
    ``indices``: :func:`~.health.day_indices`; ``checked``: :func:`~.anomaly.check_days`; ``categories``:
    :func:`~.health.category_health`.
    """
    by_group = Window.partitionBy("date", "group")
    rows = indices.withColumn("score", F.avg("index_value").over(by_group)).withColumn("used", F.count("index_value").over(by_group))
    # each group's weight once: features of a group share it
    part = F.when(F.col("used") > 0, F.col("group_weight") / F.count(F.lit(1)).over(by_group))
    rows = rows.withColumn("total", F.sum(part).over(Window.partitionBy("date")))
    marks = checked.where("value is not null").select("date", "feature", "is_anomaly", "dow_used", "residual", "sigma", "corridor_lo", "corridor_hi")
    features = rows.join(marks, ["date", "feature"], "left").select(
        "date", F.lit("feature").alias("level"), "group", "feature",
        F.col("value").alias("today_value"), F.col("base_value").alias("baseline_value"), "direction", "index_value",
        (ratio(F.col("group_weight"), F.col("total")) * ratio(F.col("index_value"), F.col("used"))).alias("contribution"),
        "is_anomaly", "dow_used", "residual", "sigma", "corridor_lo", "corridor_hi",
    )
    groups = rows.groupBy("date", "group").agg(F.first("score").alias("index_value"), (ratio(F.first("group_weight"), F.first("total")) * F.first("score")).alias("contribution"))
    weight = F.when(F.col("included"), F.col("base_weight"))
    parts = categories.select(
        "date", F.lit("category").alias("level"), "category", F.col("health").alias("index_value"),
        ratio(weight * F.col("health"), F.sum(weight).over(Window.partitionBy("date"))).alias("contribution"),
        "n_sessions_today", "base_weight", "today_share", "included", "skip_reason",
    )
    stacked = groups.withColumn("level", F.lit("group")).unionByName(features, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True)
    return stacked.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])


def ordered(decomposition: DataFrame) -> DataFrame:
    """The output order: by date, level, group, feature, category, nulls last."""
    return decomposition.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])


def load_decomposition(spark: SparkSession, path: str) -> DataFrame:
    """A stored decomposition with ``date`` as text (``yyyy-MM-dd``), whichever type it was stored as; all views take it."""
    rows = spark.read.parquet(path)
    if rows.schema["date"].dataType.typeName() == "string":
        return rows
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def additivity_violations(decomposition: DataFrame, health: DataFrame, close: float = 1e-4) -> DataFrame:
    """``date, level, total, expected`` where parts don't add up to the score; no rows if all is well."""
    sums = decomposition.groupBy("date", "level").agg(F.sum("contribution").alias("total"))
    expected = F.when(F.col("level") == "category", F.col("stratified")).otherwise(F.col("health"))
    both = sums.join(health.select("date", "health", "stratified"), "date").withColumn("expected", expected)
    return both.where((F.abs(F.col("total") - F.col("expected")) > close) | (F.col("total").isNull() != F.col("expected").isNull())).select("date", "level", "total", "expected")


def top_contributors(decomposition: DataFrame, day: str, level: str = "feature", n: int | None = 10, worst: bool = True) -> DataFrame:
    rows = decomposition.where((F.col("date") == F.lit(day).cast("date")) & (F.col("level") == level) & F.col("contribution").isNotNull())
    by = F.col("contribution").asc() if worst else F.col("contribution").desc()
    rows = rows.orderBy(by, "group", "feature", "category")
    return rows.limit(n) if n else rows


def _deltas(decomposition: DataFrame, day_from: str, day_to: str, level: str) -> DataFrame:
    keys = ["group", "feature", "category"]

    def side(day: str, name: str) -> DataFrame:
        rows = decomposition.where((F.col("date") == F.lit(day).cast("date")) & (F.col("level") == level))
        return rows.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], F.col("index_value").alias(f"{name}_index"), F.col("contribution").alias(f"{name}_contribution"))

    both = side(day_from, "from").join(side(day_to, "to"), keys, "full")
    return both.select(
        F.lit(level).alias("level"), *[F.when(F.col(k) != "", F.col(k)).alias(k) for k in keys],
        "from_index", "to_index", "from_contribution", "to_contribution",
        (F.col("to_index") - F.col("from_index")).alias("delta_index"),
        (F.col("to_contribution") - F.col("from_contribution")).alias("delta_contribution"),
    )


def explain_drop(decomposition: DataFrame, day_from: str, day_to: str, top_n: int = 10) -> DataFrame:
    """Ranked deltas between two days: all groups, ``top_n`` features and categories, and a ``total`` row.

    ``rank`` orders a level by the change of contribution, smallest first (a missing side counts as no change). The
    total row holds the change of the raw score (``delta_contribution``), of the stratified one (``delta_index``), and
    in ``n_flipped`` how many features are null on one day only, which makes part of the change structural. Without
    data for either day the result is empty.
    """
    groups, features, categories = (_deltas(decomposition, day_from, day_to, x) for x in ("group", "feature", "category"))
    by = Window.partitionBy("level").orderBy(F.coalesce("delta_contribution", F.lit(0.0)), "group", "feature", "category")
    ranked = groups.union(features).union(categories).withColumn("rank", F.row_number().over(by)).where((F.col("level") == "group") | (F.col("rank") <= top_n))
    a, b = F.col("date") == F.lit(day_from).cast("date"), F.col("date") == F.lit(day_to).cast("date")
    feature, category = F.col("level") == "feature", (F.col("level") == "category") & F.col("included")
    part = lambda day, kind: F.coalesce(F.sum(F.when(day & kind, F.col("contribution"))), F.lit(0.0))
    sums = decomposition.where(a | b).agg(
        (part(b, feature) - part(a, feature)).alias("delta_contribution"), (part(b, category) - part(a, category)).alias("delta_index"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b")
    )
    flipped = features.agg(F.count_if(F.col("from_index").isNull() != F.col("to_index").isNull()).alias("n_flipped"))
    both_days = F.col("n_a") * F.col("n_b") > 0
    total = sums.where(both_days).select(F.lit("total").alias("level"), "delta_index", "delta_contribution", F.lit(0).alias("rank"), flipped.scalar().alias("n_flipped"))
    return ranked.where(sums.select(both_days).scalar()).unionByName(total, allowMissingColumns=True)


def anomalies_of(decomposition: DataFrame, day: str) -> DataFrame:
    return decomposition.where((F.col("date") == F.lit(day).cast("date")) & (F.col("level") == "feature") & F.col("is_anomaly"))


def category_of(decomposition: DataFrame, day: str, category: str) -> DataFrame:
    """One row: the category's part of a day, with ``found``."""
    spark = decomposition.sparkSession
    asked = spark.createDataFrame([(category,)], "category string")
    rows = decomposition.where((F.col("date") == F.lit(day).cast("date")) & (F.col("level") == "category") & (F.col("category") == category))
    picked = rows.orderBy("category").limit(1).select("category", "index_value", "contribution", "n_sessions_today", "base_weight", "today_share", "included", "skip_reason", F.lit(True).alias("_hit"))
    return asked.join(picked, "category", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def day_view(decomposition: DataFrame, day: str) -> DataFrame:
    """All parts of a day, with the residual in sigmas."""
    rows = decomposition.where(F.col("date") == F.lit(day).cast("date"))
    return rows.withColumn("residual_sigmas", ratio(F.col("residual"), F.when(F.col("sigma") > 0, F.col("sigma"))))


def worst_categories(decomposition: DataFrame, day: str, n: int = 14) -> DataFrame:
    rows = decomposition.where((F.col("date") == F.lit(day).cast("date")) & (F.col("level") == "category") & F.col("included"))
    return rows.orderBy("contribution", "category").limit(n)


def timeline(metrics: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days within the range, with the first and last date available."""
    rows = metrics.withColumn("available_from", metrics.agg(F.min("date")).scalar()).withColumn("available_to", metrics.agg(F.max("date")).scalar())
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


def timeline_kpis(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: means, the worst day, alert days and their share, sessions, and the baseline's bounds and days."""
    kpis = metrics.agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("health").alias("mean_health"), F.avg("stratified").alias("mean_stratified"),
        F.min_by("date", F.struct("health", "date")).alias("worst_day"), F.count_if("has_alert").alias("alert_days"),
        F.avg(F.col("has_alert").cast("double")).alias("alert_share"), F.sum("n_sessions").alias("n_sessions"),
    )
    bounds = {"baseline_start": "baseline_start", "baseline_end": "baseline_end", "n_days": "baseline_n_days"}
    return kpis.withColumns({name: baseline.select(c).scalar() for c, name in bounds.items()})


def anomaly_days(metrics: DataFrame) -> DataFrame:
    return metrics.where("has_alert").orderBy("health", "date")
