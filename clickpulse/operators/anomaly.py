"""The detector: robust corridors around a median or around weekday means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import MAD_TO_SIGMA, ratio
from ..sources.folders import write_file

K = 3.5
DOW_THRESHOLD = 0.70
STATE_VERSION = 1
STATE = "version int, feature string, direction int, k double, use_dow boolean, center double, dow_means map<int,double>, median double, mad double, sigma double, lo double, hi double, n long"


def mad_bands(rows: DataFrame, keys: tuple[str, ...], value: str = "value", k: float = K) -> DataFrame:
    """``keys, median, mad, sigma, lo, hi, n``: median and median absolute deviation by two exact medians; nulls are skipped."""
    middle = rows.withColumn("median", F.median(value).over(Window.partitionBy(*keys)))
    bands = middle.groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.count(value).alias("n"))
    sigma = MAD_TO_SIGMA * F.col("mad")
    return bands.select(*keys, "median", "mad", sigma.alias("sigma"), (F.col("median") - k * sigma).alias("lo"), (F.col("median") + k * sigma).alias("hi"), "n")


def fit_detector(daily: DataFrame, directions: list[tuple[str, int]], k: float = K, dow_threshold: float = DOW_THRESHOLD) -> DataFrame:
    """The state of a detector, one row per feature (schema ``STATE``).

    ``daily``: ``date, feature, value`` of the baseline; ``directions``: features with -1 or 1; others are left out. A feature is centred on
    weekday means (Monday is 0) if that leaves less than ``dow_threshold`` of its standard deviation, else on its
    median; the corridor is that of the residuals. Features without data are left out.
    """
    if any(d not in (-1, 1) for _, d in directions):
        raise ValueError("a direction is -1 or 1")
    direction = F.element_at(F.create_map(*[F.lit(x) for pair in directions for x in pair]), F.col("feature"))
    rows = daily.withColumn("direction", direction).where("direction is not null").withColumn("dow", F.weekday("date"))
    by_day = Window.partitionBy("feature", "dow")
    by_feature = Window.partitionBy("feature")
    rows = rows.withColumn("dow_mean", F.avg("value").over(by_day)).withColumn("center", F.median("value").over(by_feature))
    left = ratio(F.stddev_pop(F.col("value") - F.col("dow_mean")).over(by_feature), F.stddev_pop("value").over(by_feature))
    rows = rows.withColumn("use_dow", F.coalesce(left, F.lit(1.0)) < dow_threshold)
    residual = F.col("value") - F.when(F.col("use_dow"), F.col("dow_mean")).otherwise(F.col("center"))
    bands = mad_bands(rows.withColumn("residual", residual), ("feature",), "residual", k)
    means = rows.where("dow_mean is not null").select("feature", "dow", "dow_mean").distinct().groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dow", "dow_mean")))).alias("dow_means"))
    center = F.when(~F.col("use_dow"), F.col("center")).alias("center")
    fitted = rows.select("feature", "direction", "use_dow", center).distinct().join(bands, "feature").join(means, "feature", "left")
    return fitted.select(F.lit(STATE_VERSION).alias("version"), "feature", "direction", F.lit(float(k)).alias("k"), "use_dow", "center", "dow_means", "median", "mad", "sigma", "lo", "hi", "n")


def save_detector(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").parquet(path)  # a row per feature


def load_detector(spark: SparkSession, path: str) -> DataFrame:
    """A saved state; fails on another version. Null thresholds load as null."""
    state = spark.read.schema(STATE).parquet(path)
    wrong = F.raise_error(F.concat(F.lit("detector state of version "), F.col("version").cast("string")))
    return state.withColumn("version", F.when(F.col("version") == STATE_VERSION, F.col("version")).otherwise(wrong.cast("int")))


#: The names and the version of the JSON form, in its order.
JSON_VERSION = "v1"
JSON_STATE = (
    "version string, directions map<string,int>, k double, dow_means map<string,array<double>>, use_dow map<string,boolean>, "
    "thresholds map<string,struct<lo:double,hi:double,median:double,mad:double,sigma:double,n:bigint>>, global_centers map<string,double>"
)


def detector_json(state: DataFrame) -> DataFrame:
    """``json``: one row with the whole state (features are few), which other programs read; NaN and missing numbers are null."""
    number = lambda c: F.when(~F.isnan(c), c)
    by_feature = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", value.alias("value")))))
    means = F.array(*[number(F.try_element_at("dow_means", F.lit(d))) for d in range(7)])
    limits = F.struct(*[number(F.col(c)).alias(c) for c in ("lo", "hi", "median", "mad", "sigma")], "n")
    whole = state.agg(
        F.concat(F.lit("v"), F.coalesce(F.max("version"), F.lit(STATE_VERSION)).cast("string")).alias("version"),
        by_feature(F.col("direction")).alias("directions"),
        F.max("k").alias("k"),
        by_feature(means).alias("dow_means"),
        by_feature(F.col("use_dow")).alias("use_dow"),
        by_feature(limits).alias("thresholds"),
        by_feature(number(F.col("center"))).alias("global_centers"),
    )
    return whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def save_detector_json(state: DataFrame, path: str) -> None:
    """One JSON file; fails if it exists."""
    write_file(state.sparkSession, path, detector_json(state).first()["json"])


def load_detector_json(spark: SparkSession, path: str) -> DataFrame:
    """The state of a JSON file, in the columns of ``STATE``; fails on another version. Null numbers load as null."""
    read = spark.read.schema(JSON_STATE).json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("detector state of version "), F.coalesce("version", F.lit("null"))))
    version = F.when(F.col("version") == JSON_VERSION, F.lit(STATE_VERSION)).otherwise(wrong.cast("int"))
    rows = read.select(version.alias("version"), "directions", "k", "dow_means", "use_dow", "global_centers", F.explode("thresholds").alias("feature", "t"))
    of = lambda column: F.try_element_at(column, F.col("feature"))
    days = F.filter(F.transform(of("dow_means"), lambda m, i: F.struct(i.alias("dow"), m.alias("mean"))), lambda d: d["mean"].isNotNull())
    return rows.select(
        "version", "feature", of("directions").alias("direction"), "k", of("use_dow").alias("use_dow"), of("global_centers").alias("center"),
        F.map_from_entries(days).alias("dow_means"), "t.median", "t.mad", "t.sigma", "t.lo", "t.hi", "t.n",
    )


def check_days(daily: DataFrame, state: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each day's features against the detector: residual, alerts and corridor in the feature's own scale.

    ``is_anomaly``: above the corridor where smaller is better, below it where larger is; ``is_two_sided``: either.
    Null values never alert. Days of the baseline are checked like others. ``keep``: further columns of ``daily`` to carry along.
    """
    rows = daily.join(F.broadcast(state.drop("version")), "feature")  # a row per feature
    center: Column = F.when(F.col("use_dow"), F.element_at("dow_means", F.weekday("date"))).otherwise(F.col("center"))
    rows = rows.withColumn("_center", center).withColumn("residual", F.col("value") - F.col("_center"))
    above, below = F.coalesce(F.col("residual") > F.col("hi"), F.lit(False)), F.coalesce(F.col("residual") < F.col("lo"), F.lit(False))
    return rows.select(
        *keep, "date", "feature", "direction", "value",
        F.col("use_dow").alias("dow_used"), "residual", "sigma",
        ratio(F.col("residual"), F.when(F.col("sigma") > 0, F.col("sigma"))).alias("residual_sigmas"),
        F.when(F.col("direction") == -1, above).otherwise(below).alias("is_anomaly"),
        (above | below).alias("is_two_sided"),
        (F.col("_center") + F.col("lo")).alias("corridor_lo"),
        (F.col("_center") + F.col("hi")).alias("corridor_hi"),
    )


def same_weekday_bands(daily: DataFrame, k: float = K, least: int = 3) -> DataFrame:
    """Bands per feature and weekday, for weekdays with ``least`` values or more."""
    return mad_bands(daily.withColumn("dow", F.weekday("date")), ("feature", "dow"), k=k).where(F.col("n") >= least)
