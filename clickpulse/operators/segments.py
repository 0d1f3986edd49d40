"""Weak spots: session segments by how rarely they succeed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, whole
from ..functions.text import bool_text, bucket_label

#: The segments, by the column's text or by buckets with these edges.
SEGMENTS: dict[str, tuple[str, list[int] | None]] = {
    "is_in_product_base": ("is_in_product_base", None),
    "is_article": ("is_article", None),
    "query_stratification_score": ("query_stratification_score", None),
    "query_len_bucket": ("query_len_words", [1, 2, 3, 4, 6]),
    "n_unique_queries_bucket": ("n_unique_queries", [1, 2, 3, 5]),
    "n_view_bucket": ("n_view", [0, 1, 3, 10]),
    "first_widget": ("first_widget", None),
    "top_category_in_session": ("top_category_in_session", None),
}
MIN_VOLUME = 200
MIN_LIFT = -0.05
#: The columns of an example, in the order of the output.
EXAMPLE_COLUMNS = (
    "session_idx", "ts_start", "ts_end", "first_query", "query_clean", "n_unique_queries", "n_view", "n_click", "duration_s",
    "top_category_in_session", "first_widget", "query_stratification_score", "query_len_words", "is_in_product_base", "is_article",
)


def segment_value(sessions: DataFrame, segment: str) -> Column:
    """The label of a named segment, or the text of a column; null is ``(null)``, a named segment's missing column ``(missing)``."""
    column, edges = SEGMENTS.get(segment, (segment, None))
    kinds = dict(sessions.dtypes)
    if column not in kinds:
        if segment in SEGMENTS:
            return F.lit("(missing)")
        raise KeyError(f"unknown segment: {segment!r}")
    if edges:
        return bucket_label(F.col(column), edges)
    text = bool_text(F.col(column)) if kinds[column] == "boolean" else F.col(column).cast("string")
    return F.coalesce(text, F.lit("(null)"))


def segment_rows(sessions: DataFrame, segments: tuple[str, ...] = tuple(SEGMENTS), also: tuple[str, ...] = ()) -> DataFrame:
    """Each session once per segment: ``segment, value, date`` (of ``ts_end``), its measures and the columns ``also``."""
    labels = F.array(*[F.struct(F.lit(s).alias("segment"), segment_value(sessions, s).alias("value")) for s in segments])
    rows = sessions.select(F.date_format("ts_end", "yyyy-MM-dd").alias("date"), "reached_cart", "n_unique_queries", "n_view", "duration_s", *also, F.explode(labels).alias("s"))
    return rows.select("s.segment", "s.value", "date", "reached_cart", "n_unique_queries", "n_view", "duration_s", *also)


MEASURES = ("n_unique_queries", "n_view", "duration_s")


def segment_counts(sessions: DataFrame, segments: tuple[str, ...] = tuple(SEGMENTS), also: tuple[str, ...] = ()) -> DataFrame:
    """``segment, value, date, measure, x, n, n_success``: how many sessions have which number, and how many of these succeed.

    ``also``: columns by which sessions are counted apart, too.

    Counts of several days or runs add up, so a stored table of them gives every later breakdown without the sessions. Its rows
    follow the distinct numbers of a day's segment value (counts, whole seconds), not the sessions.
    """
    rows = segment_rows(sessions, segments, also)
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("x")) for m in MEASURES])
    each = rows.select("segment", "value", "date", "reached_cart", *also, F.explode(measures).alias("m")).select("segment", "value", "date", "reached_cart", *also, "m.*")
    return each.groupBy("segment", "value", "date", *also, "measure", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("reached_cart").alias("n_success"))


def breakdown_of_counts(counts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The breakdown of what was counted (:func:`segment_counts`; rows may repeat), of the days from ``start`` to ``end`` only if given.

    Days and the whole period come from one pass with grouping sets; medians are percentiles weighted by counts. Every session
    has one value per segment, so a day's total is a window sum over the segment's rows.
    """
    if start:
        counts = counts.where(F.col("date") >= start)
    if end:
        counts = counts.where(F.col("date") <= end)
    once = F.col("measure") == MEASURES[0]
    median = lambda m: F.percentile("x", F.lit(0.5), F.when((F.col("measure") == m) & F.col("x").isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long")))
    grains = counts.groupingSets([["segment", "value", "date"], ["segment", "value"]], "segment", "value", "date").agg(
        F.sum(F.when(once, F.col("n"))).alias("n_sessions"),
        F.sum(F.when(once, F.col("n_success"))).alias("n_success"),
        median("n_unique_queries").alias("median_n_queries"),
        median("n_view").alias("median_n_views"),
        median("duration_s").alias("median_time_s"),
        F.grouping("date").alias("_all"),
    )
    grains = grains.withColumn("date", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("date")))
    total = Window.partitionBy("segment", "date")
    rate = ratio(F.col("n_success"), F.col("n_sessions"))
    overall = ratio(F.sum("n_success").over(total), F.sum("n_sessions").over(total))
    return grains.select(
        "segment", "value", "date", "n_sessions", "n_success", rate.alias("success_rate"),
        ratio(F.col("n_sessions"), F.sum("n_sessions").over(total)).alias("share"), (rate - overall).alias("lift_vs_overall"),
        whole(F.col("n_sessions") * (1 - rate)).alias("failure_volume"), "median_n_queries", "median_n_views", "median_time_s",
    )


def segment_breakdown(sessions: DataFrame, segments: tuple[str, ...] = tuple(SEGMENTS)) -> DataFrame:
    """Per segment, value and day, and over the whole period (``date`` is ``ALL``): counts, rate, lift and medians."""
    return breakdown_of_counts(segment_counts(sessions, segments))


def weak_spots(breakdown: DataFrame, min_volume: int = MIN_VOLUME, min_lift: float = MIN_LIFT, top_n: int = 20) -> DataFrame:
    """Values of the whole period that fall short of the overall rate, most failures first."""
    rows = breakdown.where((F.col("date") == "ALL") & (F.col("n_sessions") >= min_volume) & (F.col("lift_vs_overall") <= min_lift))
    return rows.orderBy(F.desc("failure_volume"), "segment", "value").limit(top_n)


def segment_day_view(breakdown: DataFrame, day: str, baseline: tuple[str, str] | None = None, min_volume: int = MIN_VOLUME, top_n: int = 20) -> DataFrame:
    """A day's segment values against their norm, most extra failures first.

    The norm is the rate over the baseline's days if any have data, else over the whole period (``norm_source``).
    """
    period = breakdown.where("date = 'ALL'").select("segment", "value", F.col("success_rate").alias("success_rate_period"), F.col("n_sessions").alias("n_sessions_period"), F.lit("period").alias("norm_source"))
    norm = period
    if baseline:
        days = breakdown.where((F.col("date") != "ALL") & F.col("date").between(*baseline))
        based = days.groupBy("segment", "value").agg(ratio(F.sum("n_success"), F.sum("n_sessions")).alias("success_rate_period"), F.sum("n_sessions").alias("n_sessions_period")).withColumn("norm_source", F.lit("baseline"))
        has = days.agg(F.count(F.lit(1))).scalar() > 0
        norm = based.where(has).unionByName(period.where(~has))
    rows = breakdown.where((F.col("date") == day) & (F.col("n_sessions") >= min_volume)).join(norm, ["segment", "value"], "left")
    rows = rows.withColumn("norm_source", F.first("norm_source", True).over(Window.partitionBy(F.lit(0))))  # a day's rows
    delta = F.col("success_rate") - F.col("success_rate_period")
    rows = rows.withColumn("delta_vs_period", delta).withColumn("extra_failures", F.coalesce(whole(F.col("n_sessions") * -delta), F.lit(0)))
    return rows.orderBy(F.desc("extra_failures"), "segment", "value").limit(top_n)


def segments_view(breakdown: DataFrame, day: str = "ALL", segment: str | None = None) -> DataFrame:
    rows = breakdown.where(F.col("date") == day)
    if segment:
        rows = rows.where(F.col("segment") == segment)
    return rows.orderBy("segment", F.desc("n_sessions"), "value")


def weak_spot_totals(spots: DataFrame) -> DataFrame:
    return spots.groupBy("segment").agg(F.sum("failure_volume").alias("failures")).orderBy(F.desc("failures"), "segment")


def example_failures(sessions: DataFrame, segment: str, value: str, day: str | None = None, n: int = 10) -> DataFrame:
    """The first ``n`` sessions of a segment value without a cart, by end and key; the user is left out."""
    rows = sessions.where((segment_value(sessions, segment) == value) & ~F.col("reached_cart"))
    if day:
        rows = rows.where(F.to_date("ts_end") == F.lit(day).cast("date"))
    return rows.orderBy("ts_end", "user_id", "session_idx").limit(n).select(*[c for c in EXAMPLE_COLUMNS if c in sessions.columns])
