"""The stages wired together: every table of the analysis as a lazy plan over events and catalogue."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, enrich, health, rca, segments, sessions, summary
from ..sources.events import shop_events, shop_products, write_by_date
from .weights import WEIGHTS, FeatureWeight, directions


@dataclass(frozen=True)
class Settings:
    """Library defaults. Without a ``baseline``, it is the first ``baseline_days`` days from the first day with data on."""

    gap_min: int = sessions.GAP_MIN
    chunk_days: int | None = None
    min_category_sessions: int = summary.MIN_CATEGORY_SESSIONS
    km_min_events: int = summary.KM_MIN_EVENTS
    min_sessions_per_category: int = health.MIN_SESSIONS_PER_CATEGORY
    baseline: tuple[str, str] | None = None
    baseline_days: int = health.BASELINE_DAYS
    mad_k: float = anomaly.K
    dow_threshold: float = anomaly.DOW_THRESHOLD
    min_volume_period: int = segments.MIN_VOLUME
    min_volume_day: int = segments.MIN_VOLUME
    min_lift: float = segments.MIN_LIFT
    weights: tuple[FeatureWeight, ...] = WEIGHTS


#: For the driver's tables, where sessions are few and long.
SHOP = Settings(gap_min=720, min_category_sessions=150, km_min_events=2, min_sessions_per_category=5, baseline=("2024-01-01", "2024-01-20"), min_volume_period=50, min_volume_day=5)


class Analysis:
    """All derived tables, built once per object and lazily; ``sessions`` may be an earlier run's table.

    From the day summary on, tables have a row per day and category or feature. They are read several times by what
    follows, so the session keeps them (on disk where memory is short; a lost part is computed again) until ``release``.
    """

    def __init__(self, events: DataFrame | None, products: DataFrame | None, settings: Settings = SHOP, sessions: DataFrame | None = None):
        self.events, self.products, self.settings, self._sessions = events, products, settings, sessions
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    def release(self) -> None:
        """The session lets go of the tables that it keeps for this object; they are built again if they are read again."""
        while self._kept:
            self._kept.pop().unpersist()

    @classmethod
    def of_shop(cls, spark: SparkSession, sf_dir: str) -> Analysis:
        return cls(shop_events(spark, sf_dir), shop_products(spark, sf_dir))

    @cached_property
    def sessions(self) -> DataFrame:
        if self._sessions is not None:
            return self._sessions
        return sessions.build_sessions(self.events, self.products, self.settings.gap_min, self.settings.chunk_days)

    @cached_property
    def kept_sessions(self) -> DataFrame:
        """For what reads sessions more than once: a stored table as it is, else built once and kept by the session."""
        return self.sessions if self._sessions is not None else self._keep(self.sessions)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enrich_sessions(self.kept_sessions, self.products)  # reads sessions twice

    @cached_property
    def summary(self) -> DataFrame:
        return self._keep(summary.day_summary(self.kept_sessions, self.settings.min_category_sessions, self.settings.km_min_events))

    @cached_property
    def baseline(self) -> tuple[str, str]:
        """The settings' baseline, or the default one, which takes a look at the day summary and fails if that is empty."""
        return self.settings.baseline or health.default_baseline(self.summary, self.settings.baseline_days)

    @cached_property
    def features(self) -> DataFrame:
        return health.feature_rows(self.summary)

    @cached_property
    def daily(self) -> DataFrame:
        return self._keep(health.daily_features(self.features))  # a row per day and feature

    @cached_property
    def baseline_daily(self) -> DataFrame:
        return health.within(self.daily, *self.baseline)

    @cached_property
    def base_values(self) -> DataFrame:
        from ..functions.numbers import ratio

        return health.within(self.features, *self.baseline).groupBy("feature").agg(ratio(F.sum("above"), F.sum("below")).alias("base_value"))

    @cached_property
    def indices(self) -> DataFrame:
        return self._keep(health.index_rows(self.daily, self.base_values, self.settings.weights))

    @cached_property
    def categories(self) -> DataFrame:
        return self._keep(health.category_health(self.summary, self.settings.weights, *self.baseline, self.settings.min_sessions_per_category))

    @cached_property
    def health(self) -> DataFrame:
        raw = health.health_of(health.group_scores(self.indices))
        return self._keep(raw.join(health.stratified(self.categories), "date", "left").withColumn("drift", F.col("stratified") - F.col("health")))

    @cached_property
    def detector(self) -> DataFrame:
        return anomaly.fit_detector(self.baseline_daily, directions(), self.settings.mad_k, self.settings.dow_threshold)

    @cached_property
    def checked(self) -> DataFrame:
        return self._keep(anomaly.check_days(self.daily, self.detector))

    @cached_property
    def metrics(self) -> DataFrame:
        return health.daily_metrics(self.summary, self.indices, self.health, self.checked, *self.baseline)

    @cached_property
    def decomposition(self) -> DataFrame:
        return self._keep(rca.decompose(self.indices, self.checked, self.categories))

    @cached_property
    def breakdown(self) -> DataFrame:
        return segments.segment_breakdown(self.enriched)

    def write(self, path: str) -> None:
        """The batch run into one folder: stages that later ones read are written and read back, the rest written once.

        :class:`~.store.RunStore` writes runs that add days, and replaces a run as a whole.
        """
        spark = self.sessions.sparkSession
        write_by_date(self.sessions.withColumn("date", F.to_date("ts_end")), f"{path}/sessions")
        Analysis(self.events, self.products, self.settings, spark.read.parquet(f"{path}/sessions")).write_tables(path)
        write_segments(spark, f"{path}/sessions", f"{path}/segment_breakdown", self.products)

    def write_tables(self, path: str) -> None:
        """All that follows from stored sessions, but for the segments.

        Scores are checked before they are written: parts that don't add up fail the run.
        """
        spark = self.sessions.sparkSession
        self.summary.orderBy("date", "category").write.mode("overwrite").parquet(f"{path}/day_summary")
        self.__dict__["summary"] = spark.read.parquet(f"{path}/day_summary")
        health.warn_absent(self.summary, tuple(w.feature for w in self.settings.weights))
        if health.within(self.summary, *self.baseline).isEmpty():
            raise ValueError("the baseline window has no rows")
        anomaly.save_detector(self.detector, f"{path}/detector")
        wrong = rca.additivity_violations(self.decomposition, self.health)
        if not wrong.isEmpty():
            raise ValueError(f"parts do not add up to the score: {wrong.limit(5).collect()}")
        self.metrics.write.mode("overwrite").parquet(f"{path}/daily_metrics")
        rca.ordered(self.decomposition).write.mode("overwrite").parquet(f"{path}/decomposition")
        self.release()

    @classmethod
    def stored(cls, spark: SparkSession, path: str, products: DataFrame | None = None, settings: Settings = SHOP) -> Analysis:
        """A written run: explanations and views start from its tables, nothing is computed again."""
        run = cls(None, products, settings, spark.read.parquet(f"{path}/sessions"))
        tables = {"summary": "day_summary", "metrics": "daily_metrics", "breakdown": "segment_breakdown"}
        run.__dict__.update({name: spark.read.parquet(f"{path}/{table}") for name, table in tables.items()})
        run.__dict__["breakdown"] = run.breakdown.withColumn("date", F.col("date").cast("string"))
        run.__dict__["decomposition"] = rca.load_decomposition(spark, f"{path}/decomposition")
        run.__dict__["detector"] = anomaly.load_detector(spark, f"{path}/detector")
        return run


def write_segments(spark: SparkSession, sessions_path: str, path: str, products: DataFrame) -> bool:
    """Writes the segment breakdown of stored sessions; warns, writes nothing and returns False if they are missing or empty."""
    try:
        rows = spark.read.parquet(sessions_path)
    except AnalysisException:
        warnings.warn(f"{sessions_path} not found: no segment breakdown", stacklevel=2)
        return False
    if rows.isEmpty():
        warnings.warn(f"{sessions_path} is empty: no segment breakdown", stacklevel=2)
        return False
    write_by_date(segments.segment_breakdown(enrich.required(enrich.enrich_sessions(rows, products))), path)
    return True
