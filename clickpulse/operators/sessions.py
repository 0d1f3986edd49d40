"""Intent sessions: a user's events, cut at gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio

GAP_MIN = 35
#: Seconds of a block: a busy user's events are scanned block by block, and blocks are put together by one small row each.
BLOCK_S = 3600
#: A user is busy who has at least one in this many of all events (so there are as many busy users at most), and this many events.
BUSY_SHARE, BUSY_LEAST = 1000, 10_000
#: Keys over which events without an item are dealt in the join with the catalogue.
SALTS = 4096
_ACTIONS = {"n_search": "search", "n_view": "view", "n_click": "click", "n_cart": "to_cart", "n_fav": "favorite"}
_SUMS = ("n_events", *_ACTIONS)
#: Columns of a piece of a session, all of which can be merged.
PIECE = ("ts_start", "ts_end", *_SUMS, "ts_first_cart", "first_query", "first_widget", "queries", "categories")


def _owner(events: DataFrame, chunk_days: int | None) -> tuple[list[str], DataFrame]:
    if not chunk_days:
        return ["user_id"], events
    first = events.agg(F.min("date")).scalar()
    return ["user_id", "chunk_start"], events.withColumn("chunk_start", F.date_sub("date", F.pmod(F.datediff("date", first), F.lit(chunk_days))))


def _seconds(column: str | Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, column)


def _begins(gap: Column, gap_min: int) -> Column:
    return F.when(gap.isNull() | (gap > gap_min * 60), 1).otherwise(0)


def busy_users(events: DataFrame, share: int = BUSY_SHARE, least: int = BUSY_LEAST) -> list:
    """Users whose events should be split, ``share`` of them at most; null may be one. Counts events by user, reading that column alone."""
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    most = counts.orderBy(F.desc("n"), "user_id").limit(share).collect()
    if not most:
        return []
    total = events.count()
    return [r["user_id"] for r in most if r["n"] * share >= total]


def is_busy(users: list) -> Column:
    """Whether ``user_id`` is one of them; never null."""
    named = F.coalesce(F.col("user_id").isin([u for u in users if u is not None]), F.lit(False))
    return named | F.col("user_id").isNull() if None in users else named


def _scan_blocks(events: DataFrame, keys: list[str], gap_min: int, block_s: int, busy: list | None = None) -> DataFrame:
    """Adds ``_block``, ``gap_s`` (null for a block's first event) and ``_local``: sessions begun in the block before the event or at it.

    A block's first event counts as none: whether it begins a session is decided at the border. All events of users who aren't in
    ``busy`` are one block; without a list, all users have blocks.
    """
    block = F.floor(_seconds(F.col("timestamp")) / block_s)
    if busy is not None:
        block = F.when(is_busy(busy), block).otherwise(F.lit(0).cast("long"))
    rows = events.withColumn("_block", block)
    in_block = Window.partitionBy(*keys, "_block").orderBy("timestamp", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("timestamp").over(in_block), F.col("timestamp"))
    begins = F.when(F.col("gap_s").isNull(), 0).otherwise(_begins(F.col("gap_s"), gap_min))
    return rows.withColumn("gap_s", gap).withColumn("_local", F.sum(begins).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))


def number_sessions(events: DataFrame, gap_min: int = GAP_MIN, chunk_days: int | None = None, block_s: int = BLOCK_S, busy: list | None = None) -> DataFrame:
    """Adds ``gap_s`` (whole seconds since the user's event before) and ``session_idx`` (from 1 for each user).

    A session starts at a user's first event and after a gap of more than ``gap_min`` minutes; tied timestamps
    go by ``event_id``. With ``chunk_days``, days are grouped into chunks from the first day on, sessions end with
    their chunk and numbering restarts in each (``chunk_start`` then belongs to the key). Events with a null user are one user's.

    A user's events are one window, but for ``busy`` users (by default those that :func:`busy_users` finds in a look at the log): a
    segmented scan numbers theirs within blocks of ``block_s`` seconds, so a task holds one block of such a user. One row per block
    then gives the gap over each border and the number of sessions before it; it comes from a second, narrow pass over these events
    (user, time and id) and meets them in their blocks.
    """
    busy = busy_users(events) if busy is None else busy
    keys, events = _owner(events, chunk_days)
    if not busy:
        return _number(events, keys, gap_min)
    return _number(events.where(~is_busy(busy)), keys, gap_min).unionByName(number_in_blocks(events.where(is_busy(busy)), keys, gap_min, block_s))


def number_in_blocks(events: DataFrame, keys: list[str], gap_min: int = GAP_MIN, block_s: int = BLOCK_S) -> DataFrame:
    """``gap_s`` and ``session_idx`` as in :func:`number_sessions`, by the segmented scan for all events."""
    owned = lambda rows: rows.withColumn("_owner", F.struct(*keys))  # noqa: E731  a null user is one user's, and meets itself in the join
    narrow = owned(_scan_blocks(events.select(*keys, "timestamp", "event_id"), keys, gap_min, block_s))
    blocks = narrow.groupBy("_owner", "_block").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.max("_local").alias("_inner"))
    by_owner = Window.partitionBy("_owner").orderBy("_block")
    border = F.timestamp_diff("SECOND", F.lag("_last").over(by_owner), F.col("_first"))
    blocks = blocks.withColumn("_border", border).withColumn("_starts", _begins(F.col("_border"), gap_min))
    before = F.sum(F.col("_starts") + F.col("_inner")).over(by_owner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")
    blocks = blocks.select("_owner", "_block", "_border", before.alias("_before"))
    split = owned(_scan_blocks(events, keys, gap_min, block_s)).join(blocks, ["_owner", "_block"])
    split = split.withColumns({"gap_s": F.coalesce("gap_s", "_border"), "session_idx": F.col("_before") + F.col("_local")})
    return split.drop("_owner", "_block", "_local", "_border", "_before")


def _number(events: DataFrame, keys: list[str], gap_min: int) -> DataFrame:
    """The same by one window per user."""
    by_user = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("timestamp").over(by_user), F.col("timestamp"))
    rows = events.withColumn("gap_s", gap)
    return rows.withColumn("session_idx", F.sum(_begins(F.col("gap_s"), gap_min)).over(by_user.rowsBetween(Window.unboundedPreceding, 0)))


def _with_category(events: DataFrame, products: DataFrame) -> DataFrame:
    """Events with ``category_name``. The join is left to Spark, which broadcasts the catalogue while its size allows; beyond that,
    events without an item (searches: a large part) are dealt over ``SALTS`` keys that no product has. Repeated ``item_id`` in
    ``products`` multiply events, as a left join does.
    """
    salt = F.when(F.col("item_id").isNull(), 1 + F.pmod(F.xxhash64("event_id"), F.lit(SALTS))).otherwise(0)
    # one key of both: of two keys, Spark would see that one is always 0 on the catalogue's side, and shuffle by the other
    key = lambda item, n: F.struct(item.alias("item"), n.cast("long").alias("salt"))
    named = products.where("item_id is not null").select(key(F.col("item_id"), F.lit(0)).alias("_key"), "category_name")
    return events.withColumn("_key", key(F.coalesce("item_id", F.lit(0)), salt)).join(named, "_key", "left").drop("_key")


def _counts(categories: Column) -> Column:
    """Names with repeats as one struct for each: ``category, n``. They are sorted once, and runs of equals measured."""
    ordered = F.array_sort(categories)
    starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))))
    stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ordered) + 1)
    found = F.transform(starts, lambda i, k: F.struct(F.element_at(ordered, i).alias("category"), (stop(k) - i).cast("long").alias("n")))
    return F.when(F.size(categories) > 0, found).otherwise(F.array().cast("array<struct<category:string,n:bigint>>"))


def _merged_counts(categories: Column) -> Column:
    """Counts by category as one struct for each category; ``categories``: such structs, categories repeated."""
    names = F.array_distinct(F.transform(categories, lambda c: c["category"]))
    total = lambda x: F.aggregate(F.filter(categories, lambda c: c["category"] == x), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    return F.transform(names, lambda x: F.struct(x.alias("category"), total(x).alias("n")))


def _merge(rows: DataFrame, *keys: str) -> DataFrame:
    """Pieces with equal keys as one piece. Most pieces are whole sessions; these keep their lists as they are."""
    merged = rows.groupBy(*keys).agg(
        F.min("ts_start").alias("ts_start"),
        F.max("ts_end").alias("ts_end"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("ts_first_cart").alias("ts_first_cart"),
        F.min("first_query").alias("first_query"),
        F.min("first_widget").alias("first_widget"),
        F.collect_list("queries").alias("queries"),
        F.collect_list("categories").alias("categories"),
    )
    one = lambda c, several: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(several)
    merged = merged.withColumn("_flat", one("categories", F.flatten("categories")))
    categories = F.when(F.size("categories") == 1, F.col("_flat")).otherwise(_merged_counts(F.col("_flat")))
    return merged.withColumns({"queries": one("queries", F.array_distinct(F.flatten("queries"))), "categories": categories}).drop("_flat")


def session_pieces(events: DataFrame, products: DataFrame, gap_min: int = GAP_MIN, chunk_days: int | None = None, block_s: int = BLOCK_S, busy: list | None = None) -> DataFrame:
    """``_owner, _block, _local`` and the columns ``PIECE``: what each session holds of each block of its user.

    One shuffle by user and block serves the scan and the grouping, which is by the key's columns, as Spark sorts a struct far more
    slowly. Users who aren't in ``busy`` have one block, and their categories are gathered and counted in one grouping: no session
    of theirs has more events than a busy user has at least. Without a list all have blocks of ``block_s`` seconds, and events are counted by
    category first, so that no row holds a name for each event.
    """
    if busy:  # both kinds
        quiet = session_pieces(events.where(~is_busy(busy)), products, gap_min, chunk_days, block_s, [])
        return quiet.unionByName(session_pieces(events.where(is_busy(busy)), products, gap_min, chunk_days, block_s))
    keys, events = _owner(events, chunk_days)
    rows = _with_category(events, products)
    rows = _scan_blocks(rows, keys, gap_min, block_s, busy)
    action = F.col("action_type")
    search = action == "search"
    by = [*keys, "_block", "_local"]

    def first(column: str) -> Column:
        return F.min(F.when(search & F.col(column).isNotNull(), F.struct("timestamp", "event_id", F.col(column).alias("value"))))

    sums = [
        F.min("timestamp").alias("ts_start"),
        F.max("timestamp").alias("ts_end"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(action == kind).alias(name) for name, kind in _ACTIONS.items()],
        F.min(F.when(action == "to_cart", F.col("timestamp"))).alias("ts_first_cart"),
        first("search_query").alias("first_query"),
        first("widget_name").alias("first_widget"),
        F.collect_set(F.when(search, F.col("search_query"))).alias("queries"),
    ]
    if busy is None:
        counted = F.array(F.struct(F.col("category_name").alias("category"), F.col("n_events").alias("n")))
        of_category = rows.groupBy(*by, "category_name").agg(*sums)
        pieces = _merge(of_category.withColumn("categories", F.when(F.col("category_name").isNotNull(), counted).otherwise(F.array().cast("array<struct<category:string,n:bigint>>"))), *by)
    else:
        pieces = rows.groupBy(*by).agg(*sums, F.collect_list("category_name").alias("categories")).withColumn("categories", _counts(F.col("categories")))
    return pieces.select(F.struct(*keys).alias("_owner"), "_block", "_local", *PIECE)


def stitch(pieces: DataFrame, gap_min: int = GAP_MIN) -> DataFrame:
    """Sessions of pieces: one row per session, ``_owner, session_idx`` and the merged columns ``PIECE``.

    A piece goes on with the user's session before if the gap between them allows it. A piece with a number in ``_number`` (a
    column that may be missing) comes before the user's others and has that number. A user has a few rows per block here, whatever
    its number of events. Sessions without a search are among them; a session's distinct queries are held by one aggregate.
    """
    keys = pieces.schema["_owner"].dataType.names
    pieces = pieces.select("_owner.*", *[c for c in pieces.columns if c != "_owner"])
    by_owner = Window.partitionBy(*keys).orderBy("_block", "_local")
    gap = F.timestamp_diff("SECOND", F.lag("ts_end").over(by_owner), F.col("ts_start"))
    begins = _begins(gap, gap_min)
    if "_number" in pieces.columns:
        begins = F.coalesce("_number", begins)
    numbered = pieces.withColumn("_begins", begins).withColumn("session_idx", F.sum("_begins").over(by_owner.rowsBetween(Window.unboundedPreceding, 0)))
    return _merge(numbered, *keys, "session_idx").select(F.struct(*keys).alias("_owner"), "session_idx", *PIECE)


def whole_pieces(pieces: DataFrame) -> DataFrame:
    """What :func:`stitch` gives where users have one block and no piece from before: each piece is a session."""
    return pieces.select("_owner", (F.col("_local") + 1).alias("session_idx"), *PIECE)


def finished(sessions: DataFrame) -> DataFrame:
    """Session columns of what :func:`stitch` gives; sessions without a search go."""
    top = F.array_min(F.transform("categories", lambda c: F.struct((-c["n"]).alias("minus"), c["category"].alias("category"))))["category"]
    return sessions.where("n_search > 0").select(
        "_owner.*", "session_idx", "ts_start", "ts_end", *_SUMS,
        F.size("queries").cast("long").alias("n_unique_queries"),
        F.col("first_query.value").alias("first_query"),
        F.col("first_widget.value").alias("first_widget"),
        F.size("categories").cast("long").alias("n_unique_categories"),
        top.alias("top_category_in_session"),
        "ts_first_cart",
        F.timestamp_diff("SECOND", "ts_start", "ts_end").alias("duration_s"),
        (F.col("n_cart") > 0).alias("reached_cart"),
        F.timestamp_diff("SECOND", "ts_start", "ts_first_cart").alias("time_to_cart_s"),
    )


def build_sessions(events: DataFrame, products: DataFrame, gap_min: int = GAP_MIN, chunk_days: int | None = None, block_s: int = BLOCK_S, busy: list | None = None) -> DataFrame:
    """One row for each session with a search: times, counts, first query and widget, categories, time to cart.

    ``first_query`` and ``first_widget`` are each the first that isn't null among searches. The modal category is the
    smallest of equally frequent ones.

    The log is shuffled once, by user, for numbering and grouping. Events of ``busy`` users (by default those that
    :func:`busy_users` finds in a look at the log) are shuffled by user and block of time instead, and make pieces of sessions, which
    are small and stitched by user.
    """
    busy = busy_users(events) if busy is None else busy
    keys, rest = _owner(events.where(~is_busy(busy)) if busy else events, chunk_days)
    keys.append("session_idx")
    rows = _number(_with_category(rest, products), keys[:-1], gap_min)
    action = F.col("action_type")
    search = action == "search"
    order = F.struct("timestamp", "event_id")

    def first(column: str) -> Column:
        return F.min_by(column, F.when(search & F.col(column).isNotNull(), order))

    sessions = rows.groupBy(*keys).agg(
        F.min("timestamp").alias("ts_start"),
        F.max("timestamp").alias("ts_end"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(action == kind).alias(name) for name, kind in _ACTIONS.items()],
        F.size(F.collect_set(F.when(search, F.col("search_query")))).cast("long").alias("n_unique_queries"),
        first("search_query").alias("first_query"),
        first("widget_name").alias("first_widget"),
        F.size(F.collect_set("category_name")).cast("long").alias("n_unique_categories"),
        F.mode("category_name", True).alias("top_category_in_session"),
        F.min(F.when(action == "to_cart", F.col("timestamp"))).alias("ts_first_cart"),
    )
    sessions = sessions.where("n_search > 0").withColumns(
        {
            "duration_s": F.timestamp_diff("SECOND", "ts_start", "ts_end"),
            "reached_cart": F.col("n_cart") > 0,
            "time_to_cart_s": F.timestamp_diff("SECOND", "ts_start", "ts_first_cart"),
        }
    )
    if not busy:
        return sessions
    split = session_pieces(events.where(is_busy(busy)), products, gap_min, chunk_days, block_s)
    return sessions.unionByName(finished(stitch(split, gap_min)))


def session_violations(sessions: DataFrame) -> DataFrame:
    """``rule, n`` for each documented invariant of sessions; ``n`` rows break it."""
    rules = {
        "has_search": F.col("n_search") < 1,
        "counters_sum": F.col("n_events") != F.col("n_search") + F.col("n_view") + F.col("n_click") + F.col("n_cart") + F.col("n_fav"),
        "times_ordered": F.col("ts_start") > F.col("ts_end"),
        "cart_flag": F.col("reached_cart") != (F.col("n_cart") > 0),
        "cart_time": (F.col("ts_first_cart").isNotNull() != F.col("reached_cart")) | ~F.coalesce(F.col("time_to_cart_s").between(0, F.col("duration_s")), F.lit(True)),
        "category_flag": (F.col("n_unique_categories") > 0) != F.col("top_category_in_session").isNotNull(),
        "query_count": F.col("n_unique_queries") > F.col("n_search"),
    }
    broken = sessions.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    repeated = sessions.groupBy("user_id", "session_idx").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique_key").alias("rule"), "n")
    return broken.unpivot([], list(rules), "rule", "n").unionByName(repeated)


def gap_histogram(events: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """``log10_gap_bin, n``: gaps between a user's events in minutes, by 1/40 of a decade; gaps of 0 are left out.

    Gaps within a block of time come from a window over it, gaps between a user's blocks from their ends.
    """
    rows = events.select(F.struct("user_id").alias("_owner"), F.floor(_seconds(F.col("timestamp")) / block_s).alias("_block"), "timestamp")
    in_block = Window.partitionBy("_owner", "_block").orderBy("timestamp")
    inner = rows.select(F.timestamp_diff("SECOND", F.lag("timestamp").over(in_block), F.col("timestamp")).alias("gap_s"))
    ends = rows.groupBy("_owner", "_block").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    border = ends.select(F.timestamp_diff("SECOND", F.lag("last").over(Window.partitionBy("_owner").orderBy("_block")), F.col("first")).alias("gap_s"))
    return gap_bins(inner.unionByName(border))


def gap_bins(gaps: DataFrame) -> DataFrame:
    """``log10_gap_bin, n`` of gaps in seconds (``gap_s``); null and 0 don't count."""
    minutes = gaps.select((F.col("gap_s") / 60.0).alias("gap_min")).where("gap_min > 0")
    return minutes.groupBy((F.floor(F.log10("gap_min") * 40) / 40).alias("log10_gap_bin")).agg(F.count(F.lit(1)).alias("n"))


LOG_BINS = 119
LOG_FROM, LOG_TO = "log10(1.0D / 60)", "log10(60.0D * 24 * 7)"


def gap_valleys(histogram: DataFrame, order: int = 4, keep: int = 3) -> DataFrame:
    """``bin, n, centre_min``: the ``keep`` lowest strict minima of the histogram over 119 equal log bins.

    A bin is a minimum if it is lower than ``order`` bins on either side; bins nearer to the edges don't count, empty
    bins do. Ties go to the earlier bin.
    """
    spark = histogram.sparkSession
    low, high = F.expr(LOG_FROM), F.expr(LOG_TO)
    width = (high - low) / LOG_BINS
    at = F.floor((F.col("log10_gap_bin") - low) / width).cast("long")
    binned = histogram.select(at.alias("bin"), "n").where(F.col("bin").between(0, LOG_BINS - 1)).groupBy("bin").agg(F.sum("n").alias("n"))
    full = spark.range(LOG_BINS).select(F.col("id").alias("bin")).join(binned, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    line = Window.partitionBy(F.lit(0)).orderBy("bin")  # 119 rows
    sides = full.withColumn("left", F.min("n").over(line.rowsBetween(-order, -1))).withColumn("right", F.min("n").over(line.rowsBetween(1, order)))
    found = sides.where((F.col("n") < F.col("left")) & (F.col("n") < F.col("right")) & F.col("bin").between(order, LOG_BINS - 1 - order))
    return found.orderBy("n", "bin").limit(keep).select("bin", "n", F.pow(F.lit(10.0), low + (F.col("bin") + 0.5) * width).alias("centre_min"))


def conversion_interval(sessions: DataFrame) -> DataFrame:
    """Conversion of all sessions with its 95 % interval."""
    from ..functions.numbers import proportion_margin

    p = ratio(F.col("converted"), F.col("n"))
    total = sessions.agg(F.count(F.lit(1)).alias("n"), F.count_if("reached_cart").alias("converted"))
    return total.select("n", p.alias("rate"), (p - proportion_margin(p, F.col("n"))).alias("low"), (p + proportion_margin(p, F.col("n"))).alias("high"))
