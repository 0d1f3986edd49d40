"""Event log and catalogue: readers, writers, and the adapter over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_COLUMNS = ("user_id", "date", "timestamp", "event_id", "action_type", "widget_name", "search_query", "item_id")
PRODUCT_COLUMNS = ("item_id", "name", "brand", "type", "category_name")


def read_events(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The log under ``root`` (partitioned by ``date`` and ``action_type``) within ``[start, end]``, both included.

    The range prunes partitions and only the columns of ``EVENT_COLUMNS`` are read. Timestamps of nanoseconds, which
    Spark reads as longs under ``spark.sql.legacy.parquet.nanosAsLong``, become microseconds.
    """
    return date_range(normal_timestamps(spark.read.parquet(root)), start, end).select(*EVENT_COLUMNS)


def normal_timestamps(events: DataFrame) -> DataFrame:
    if dict(events.dtypes).get("timestamp") == "bigint":
        return events.withColumn("timestamp", F.timestamp_micros(F.expr("timestamp div 1000")).cast("timestamp_ntz"))
    return events


def date_range(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        events = events.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        events = events.where(F.col("date") <= F.lit(end).cast("date"))
    return events


def read_products(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select(*PRODUCT_COLUMNS)


def write_by_date(df: DataFrame, path: str) -> None:
    """One directory per ``date``; a rerun replaces only the dates it has."""
    df.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_daily(spark: SparkSession, *paths: str) -> DataFrame:
    """Daily tables, one file or directory each, as one table."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def optional_column(df: DataFrame, name: str, default: Column) -> Column:
    """The column if the table has it, else a default."""
    return F.col(name) if name in df.columns else default


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search log made of the driver's ``events`` and ``part`` tables.

    Signups stand for searches, purchases for cart events, errors for favourites; ``props.k`` names the item.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_name", "p_brand")
    search = F.col("event_type") == "signup"
    action = F.when(search, "search").when(F.col("event_type") == "purchase", "to_cart").when(F.col("event_type") == "error", "favorite").otherwise(F.col("event_type"))
    widget = F.when(F.col("event_id") % 4 == 0, "search_suggestions").when(F.col("event_id") % 4 == 1, "mobile_search_bar").when(F.col("event_id") % 4 == 2, "web_search_bar")
    nth = F.col("event_id") % 5
    query = (
        F.when(nth == 0, F.col("k").cast("string"))
        .when(nth == 1, F.concat(F.upper("p_name"), F.lit("  ")))
        .when(nth == 2, F.concat_ws(" ", "p_name", "p_brand"))
        .when(nth == 3, F.col("p_brand"))
    )
    return e.join(p, "k", "left").select(
        "user_id",
        F.to_date("timestamp").alias("date"),
        "timestamp",
        "event_id",
        action.alias("action_type"),
        F.when(search, widget).alias("widget_name"),
        F.when(search, query).alias("search_query"),
        F.when(~search, F.col("k")).alias("item_id"),
    )


def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_type").alias("category_name"))
