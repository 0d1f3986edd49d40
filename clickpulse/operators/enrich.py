"""Features of a session's first query against the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_query, word_count

ENRICHED = ("query_clean", "query_len_words", "is_in_product_base", "is_article", "query_stratification_score")


def catalog_texts(products: DataFrame) -> DataFrame:
    """Distinct normalized names, brands, types and categories, without empty ones: ``text``."""
    texts = products.select(F.explode(F.array("name", "brand", "type", "category_name")).alias("text"))
    return texts.select(normalize_query(F.col("text")).alias("text")).where("text <> ''").distinct()


def catalog_articles(products: DataFrame) -> DataFrame:
    """Distinct item ids as text: ``text``."""
    return products.select(F.trim(F.col("item_id").cast("string")).alias("text")).where("text is not null").distinct()


#: The first bound that a number doesn't exceed gives its points; numbers beyond the last bound get one more.
QUERY_STEPS = (1, 3, 7, 19)
WORD_STEPS = (2, 4, 6)


def points(value: Column, steps: tuple[int, ...]) -> Column:
    """How many of the bounds a number exceeds."""
    return reduce(lambda a, b: a + b, [(value > bound).cast("int") for bound in steps])


#: A query that at least one in this many sessions start with is popular, if it starts this many; there are so many popular queries at most.
POPULAR, POPULAR_LEAST = 1000, 10_000
#: Keys over which sessions without a query or with a popular one are dealt.
SALTS = 4096
_FLAGS = ("is_in_product_base", "is_article")


def catalog_matches(products: DataFrame) -> DataFrame:
    """``query_clean, is_in_product_base, is_article``: one row for each text that the catalogue has as a name or as an id.

    Names and ids are counted in one grouping, so the catalogue is read and shuffled once.
    """
    named = F.transform(F.array_distinct(F.array("name", "brand", "type", "category_name")), lambda t: F.struct(normalize_query(t).alias("text"), F.lit(False).alias("article")))
    article = F.array(F.struct(F.trim(F.col("item_id").cast("string")).alias("text"), F.lit(True).alias("article")))
    texts = products.select(F.explode(F.concat(named, article)).alias("t")).select("t.*").where("text is not null and (article or text <> '')")
    return texts.groupBy(F.col("text").alias("query_clean")).agg(F.bool_or(~F.col("article")).alias("is_in_product_base"), F.bool_or("article").alias("is_article"))


def popular_queries(queries: DataFrame, share: int = POPULAR, least: int = POPULAR_LEAST) -> list[str]:
    """Values of ``query_clean`` that many rows share, ``share`` of them at most; null isn't one."""
    counts = queries.where("query_clean is not null").groupBy("query_clean").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    most = counts.orderBy(F.desc("n"), "query_clean").limit(share).collect()
    if not most:
        return []
    total = queries.count()
    return [r["query_clean"] for r in most if r["n"] * share >= total]


def enrich_sessions(sessions: DataFrame, products: DataFrame, popular: list[str] | None = None) -> DataFrame:
    """Adds the columns ``ENRICHED``.

    The score of difficulty runs from 0 to 5: points for many queries and for many words, one each for a query that the
    catalogue lacks, for no click and for no cart; two less for an article's number.

    Sessions meet the catalogue's names and ids in one join, in which those without a query, and those with a ``popular`` one
    (by default those that :func:`popular_queries` finds in a look at the sessions), are dealt over keys that no text has; so no key holds
    more than one in ``POPULAR`` sessions. Popular queries, ``POPULAR`` at most, are matched once each and broadcast. Sessions
    are read twice, so they should be stored or kept.
    """
    rows = sessions.withColumn("query_clean", normalize_query(F.col("first_query")))
    popular = popular_queries(rows.select("query_clean")) if popular is None else popular
    texts = catalog_matches(products)
    dealt = F.col("query_clean").isNull() | F.col("query_clean").isin(popular) if popular else F.col("query_clean").isNull()
    salt = F.when(dealt, 1 + F.pmod(F.xxhash64("user_id", "session_idx"), F.lit(SALTS))).otherwise(0)
    # one key of both: of two keys, Spark would see that one is always 0 on the catalogue's side, and shuffle by the other
    key = lambda text, n: F.struct(text.alias("text"), n.cast("long").alias("salt"))
    matches = texts.select(key(F.col("query_clean"), F.lit(0)).alias("_key"), *[F.col(c).alias(f"_{c}") for c in _FLAGS])
    rows = rows.withColumn("_key", key(F.when(~dealt, F.col("query_clean")).otherwise(""), salt)).join(matches, "_key", "left")
    found = {c: F.col(f"_{c}") for c in _FLAGS}
    if popular:
        often = texts.where(F.col("query_clean").isin(popular)).select("query_clean", *[F.col(c).alias(f"_often_{c}") for c in _FLAGS])
        rows = rows.join(F.broadcast(often), "query_clean", "left")  # POPULAR rows at most
        found = {c: F.coalesce(F.col(f"_often_{c}"), F.col(f"_{c}")) for c in _FLAGS}
    rows = rows.withColumns({c: F.coalesce(value, F.lit(False)) for c, value in found.items()})
    rows = rows.drop("_key", *[f"{p}{c}" for p in ("_", "_often_") for c in _FLAGS]).withColumn("query_len_words", word_count(F.col("query_clean")))
    misses = [~F.col("is_in_product_base"), F.col("n_click") == 0, ~F.col("reached_cart")]
    score = points(F.col("n_unique_queries"), QUERY_STEPS) + points(F.col("query_len_words"), WORD_STEPS) - 2 * F.col("is_article").cast("int")
    score = reduce(lambda a, b: a + b, [m.cast("int") for m in misses], score)
    return rows.withColumn("query_stratification_score", F.greatest(F.lit(0), F.least(F.lit(5), score)).cast("tinyint"))


def enriched_contract(enriched: DataFrame) -> DataFrame:
    """One row: rows, range of the score, and how many scores are out of range or null. Raises on missing columns."""
    missing = [c for c in ENRICHED if c not in enriched.columns]
    if missing:
        raise ValueError(f"enriched sessions lack {missing}")
    score = F.col("query_stratification_score").cast("long")
    return enriched.agg(F.count(F.lit(1)).alias("n_rows"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count_if(score.isNull() | ~score.between(0, 5)).alias("n_bad"))


def required(enriched: DataFrame) -> DataFrame:
    """The same rows; the job that reads them fails at a score that is null or out of range. Raises on missing columns at once."""
    missing = [c for c in ENRICHED if c not in enriched.columns]
    if missing:
        raise ValueError(f"enriched sessions lack {missing}")
    score = F.col("query_stratification_score")
    wrong = F.raise_error(F.concat(F.lit("score of difficulty out of 0 to 5: "), F.coalesce(score.cast("string"), F.lit("null"))))
    return enriched.withColumn("query_stratification_score", F.when(score.between(0, 5), score).otherwise(wrong.cast("tinyint")))


def verify_against(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ENRICHED, keys: tuple[str, ...] = ("user_id", "session_idx")) -> DataFrame:
    """``column, n_different``: rows of either table whose values differ, aligned by key; a missing row differs in all."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, list(keys), "full")
    lost = F.col("a").isNull() | F.col("b").isNull()
    counts = both.agg(*[F.count_if(lost | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_different")
