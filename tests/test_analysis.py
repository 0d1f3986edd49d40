"""The analysis on tiny tables: sessions, medians, scores, detector, explanations, segments."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickpulse.functions.numbers import feature_index
from clickpulse.functions.text import bucket_label, normalize_query, word_count
from clickpulse.operators import anomaly, enrich, health, rca, segments, sessions, summary
from clickpulse.plans.tables import Analysis, Settings, write_segments
from clickpulse.plans.weights import FeatureWeight
from clickpulse.sources.events import EVENT_COLUMNS, PRODUCT_COLUMNS, normal_timestamps, read_daily, read_events, read_products
from clickpulse.streaming.sessions import stream_sessions

WEIGHTS = (
    FeatureWeight("quality", 0.6, "dead_search_rate", -1),
    FeatureWeight("quality", 0.6, "cart_rate", 1),
    FeatureWeight("engagement", 0.4, "rate_views", 1),
)
EVENTS = "user_id long, date date, timestamp timestamp_ntz, event_id long, action_type string, widget_name string, search_query string, item_id long"


def events(spark, rows):
    """Rows: user, seconds from the epoch's day 2024-03-01, action, query, widget, item."""
    start = dt.datetime(2024, 3, 1)
    made = []
    for i, (user, s, action, *rest) in enumerate(rows):
        query, widget, item = (*rest, None, None, None)[:3]
        t = start + dt.timedelta(seconds=s)
        made.append((user, t.date(), t, i, action, widget, query, item))
    return spark.createDataFrame(made, EVENTS)


@pytest.fixture(scope="module")
def products(spark):
    rows = [(1, "Молоко  Простоквашино", "Brand", "milk", "dairy"), (2, "Ёлка", None, "tree", "home"), (3, "cup", "b", "cup", "home")]
    return spark.createDataFrame(rows, "item_id long, name string, brand string, type string, category_name string")


def test_gap_is_on_whole_seconds(spark, products):
    rows = [(1, 0, "search"), (1, 2100, "view"), (1, 2100 + 2100.9, "view"), (1, 2100 + 2100.9 + 2101, "search")]
    got = sessions.number_sessions(events(spark, rows)).orderBy("event_id").collect()
    assert [r["session_idx"] for r in got] == [1, 1, 1, 2] and got[0]["gap_s"] is None and got[2]["gap_s"] == 2100


def test_sessions(spark, products):
    rows = [
        (1, 0, "search", None, "w0"), (1, 10, "search", "b", None), (1, 10, "search", "a", "w1"), (1, 20, "click", None, None, 1), (1, 21, "click", None, None, 2), (1, 30.9, "to_cart", None, None, 2),
        (2, 0, "view"), (2, 5000, "search", "x"), (3, 0, "search"),
    ]
    got = {(r["user_id"], r["session_idx"]): r for r in sessions.build_sessions(events(spark, rows), products).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1)}  # a session without a search goes after numbering
    one = got[1, 1]
    assert (one["first_query"], one["first_widget"], one["n_unique_queries"], one["n_events"]) == ("b", "w0", 2, 6)
    assert (one["top_category_in_session"], one["n_unique_categories"], one["time_to_cart_s"], one["duration_s"]) == ("home", 2, 30, 30)
    assert got[3, 1]["n_unique_queries"] == 0 and got[3, 1]["top_category_in_session"] is None and got[3, 1]["time_to_cart_s"] is None
    built = sessions.build_sessions(events(spark, rows), products)
    assert sessions.session_violations(built).agg(F.sum("n")).first()[0] == 0


def test_modal_tie_and_midnight(spark, products):
    rows = [(1, 0, "search"), (1, 1, "view", None, None, 1), (1, 2, "view", None, None, 3)]
    assert sessions.build_sessions(events(spark, rows), products).first()["top_category_in_session"] == "dairy"
    late = [(1, 86390, "search"), (1, 86410, "search"), (1, 86420, "view")]
    assert sessions.build_sessions(events(spark, late), products).count() == 1
    cut = sessions.build_sessions(events(spark, late), products, chunk_days=1).orderBy("chunk_start").collect()
    assert [(str(r["chunk_start"]), r["session_idx"], r["n_events"]) for r in cut] == [("2024-03-01", 1, 1), ("2024-03-02", 1, 2)]


def test_empty_tables(spark, products):
    a = Analysis(events(spark, []), products.limit(0), Settings(baseline=("2024-03-01", "2024-03-02")))
    for df in (a.sessions, a.enriched, a.summary, a.daily, a.health, a.detector, a.checked, a.decomposition, a.breakdown, a.metrics):
        assert df.count() == 0


def km_by_hand(rows, least):
    events_at = sorted(rows)
    alive, n = 1.0, len(rows)
    if sum(e for _, e in rows) < least:
        return None
    for t in sorted({t for t, _ in events_at}):
        d = sum(1 for x, e in rows if x == t and e)
        alive *= 1 - d / n
        n -= sum(1 for x, _ in rows if x == t)
        if d and alive <= 0.5:
            return float(t)
    return None


def test_km_median_against_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(60):
        group = [(rng.randint(0, 12), rng.random() < 0.4 + 0.01 * g) for _ in range(rng.randint(1, 40))]
        want[g] = km_by_hand(group, 3)
        rows += [(g, "c", t if e else None, t, e) for t, e in group]
    df = spark.createDataFrame(rows, "date int, category string, time_to_cart_s long, duration_s long, reached_cart boolean")
    got = {r["date"]: r["km_median_time_to_cart_s"] for r in summary.km_median(df, min_events=3).collect()}
    assert got == want and None in want.values()


def test_category_fold_at_the_threshold(spark):
    t = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([(t, "a")] * 3 + [(t, "b")] * 2 + [(t, None)] * 5, "ts_end timestamp_ntz, top_category_in_session string")
    assert {r["category"]: r["count"] for r in summary.fold_categories(df, 3).groupBy("category").count().collect()} == {"a": 3, "other": 7}


def test_index_and_labels(spark):
    df = spark.createDataFrame([(0.22, 0.20, -1), (0.18, 0.20, -1), (1.1, 1.0, 1), (None, 1.0, 1), (1.0, 0.0, 1), (1.0, None, 1)], "a double, b double, d int")
    assert [r[0] and round(r[0], 6) for r in df.select(feature_index(F.col("a"), F.col("b"), F.col("d"))).collect()] == [90, 110, 110, None, None, None]
    v = spark.createDataFrame([(None,), (-1,), (0,), (1,), (2,), (3,), (5,), (6,)], "v int")
    assert [r[0] for r in v.select(bucket_label(F.col("v"), [1, 2, 3, 6])).collect()] == ["(null)", "(null)", "<1", "1", "2", "3-5", "3-5", "6+"]
    q = spark.createDataFrame([("  МОЛОКО   ПростоквашИно ",), ("Ёж  x",), ("",), (None,), ("   ",)], "q string").select(normalize_query(F.col("q")).alias("c"))
    assert [tuple(r) for r in q.select("c", word_count(F.col("c"))).collect()] == [("молоко простоквашино", 2), ("еж x", 2), ("", 0), (None, 0), ("", 0)]


SPECS = {"A": (1000, 0.5, 0.20, 1.00, 20.0), "B": (500, 0.3, 0.40, 0.60, 10.0)}
TODAY = {"A": (1000, 0.5, 0.26, 0.90, 17.0), "B": (500, 0.3, 0.48, 0.54, 9.0)}


def day_rows(day, specs):
    return [(dt.date.fromisoformat(day), c, n, n, round(conv * n), dead, cart, views) for c, (n, conv, dead, cart, views) in specs.items()]


def day_table(spark, *days):
    schema = "date date, category string, n_users long, n_sessions long, is_cart long, dead_search_rate double, cart_rate double, rate_views double"
    base = [r for i in range(1, 8) for r in day_rows(f"2024-03-0{i}", SPECS)]
    return spark.createDataFrame(base + [r for d in days for r in d], schema)


BASE = ("2024-03-01", "2024-03-07")


def scores(spark, specs, **more):
    table = day_table(spark, day_rows("2024-03-08", specs))
    return {str(r["date"]): r for r in health.daily_health(table, WEIGHTS, *BASE, **more).collect()}


def test_health(spark):
    same = scores(spark, SPECS)
    assert abs(same["2024-03-08"]["health"] - 100) < 1e-9 and abs(same["2024-03-03"]["stratified"] - 100) < 1e-9
    carts = {c: (n, v, d, k * 1.1, x) for c, (n, v, d, k, x) in SPECS.items()}
    assert abs(scores(spark, carts)["2024-03-08"]["health"] - (0.6 * 105 + 0.4 * 100)) < 1e-6
    missing = {c: (n, v, d * 1.2, None, x) for c, (n, v, d, k, x) in SPECS.items()}
    assert abs(scores(spark, missing)["2024-03-08"]["health"] - (0.6 * 80 + 0.4 * 100)) < 1e-6
    group = {c: (n, v, None, float("nan"), x) for c, (n, v, d, k, x) in SPECS.items()}
    assert abs(scores(spark, group)["2024-03-08"]["health"] - 100) < 1e-6
    shifted = {"A": (400, *SPECS["A"][1:]), "B": (600, *SPECS["B"][1:])}
    day = scores(spark, shifted)["2024-03-08"]
    assert abs(day["stratified"] - 100) < 1e-6 and abs(day["health"] - 100) > 1 and abs(day["drift"] - (day["stratified"] - day["health"])) < 1e-9


def test_skip_reasons(spark):
    table = day_table(spark, day_rows("2024-03-08", {"A": SPECS["A"], "B": (10, *SPECS["B"][1:]), "new": SPECS["A"]}), day_rows("2024-03-09", {"A": (1000, 0.5, None, None, None)}))
    got = {(str(r["date"]), r["category"]): r for r in health.category_health(table, WEIGHTS, *BASE).collect()}
    assert (got["2024-03-08", "B"]["skip_reason"], got["2024-03-09", "B"]["skip_reason"], got["2024-03-09", "A"]["skip_reason"]) == ("low_volume", "missing_today", "nan_health")
    assert got["2024-03-08", "A"]["included"] and ("2024-03-08", "new") not in got and got["2024-03-08", "B"]["health"] is not None


@pytest.fixture(scope="module")
def explained(spark):
    table = day_table(spark, day_rows("2024-03-08", TODAY))
    rows = health.feature_rows(table, ("dead_search_rate", "cart_rate", "rate_views"))
    daily = health.daily_features(rows)
    state = anomaly.fit_detector(health.within(daily, *BASE), [(w.feature, w.direction) for w in WEIGHTS])
    indices = health.day_indices(table, WEIGHTS, *BASE)
    parts = rca.decompose(indices, anomaly.check_days(daily, state), health.category_health(table, WEIGHTS, *BASE)).persist()
    return parts, health.daily_health(table, WEIGHTS, *BASE).persist()


def test_parts_add_up(explained):
    parts, total = explained
    assert rca.additivity_violations(parts, total, 1e-9).count() == 0
    assert rca.additivity_violations(parts.withColumn("contribution", F.col("contribution") + 0.1), total).count() == 24
    day = parts.where("date = '2024-03-08'")
    assert {r["level"]: r["count"] for r in day.groupBy("level").count().collect()} == {"group": 2, "feature": 3, "category": 2}
    assert day.where("is_anomaly").count() == 3 and list(parts.columns) == list(rca.COLUMNS)


def test_explain(explained):
    parts, total = explained
    h = {str(r["date"]): r["health"] for r in total.collect()}
    got = rca.explain_drop(parts, "2024-03-07", "2024-03-08").collect()
    whole = next(r for r in got if r["level"] == "total")
    assert abs(whole["delta_contribution"] - (h["2024-03-08"] - h["2024-03-07"])) < 1e-9 and whole["n_flipped"] == 0
    assert abs(sum(r["delta_contribution"] for r in got if r["level"] == "feature") - whole["delta_contribution"]) < 1e-9
    assert rca.explain_drop(parts, "2024-03-07", "2030-01-01").count() == 0
    assert [r["found"] for r in (rca.category_of(parts, "2024-03-08", c).first() for c in ("A", "none"))] == [True, False]
    assert rca.top_contributors(parts, "2024-03-08", n=1).first()["feature"] == "cart_rate" or rca.top_contributors(parts, "2024-03-08").count() == 3


@pytest.fixture(scope="module")
def daily56(spark):
    rng = random.Random(1)
    rows = []
    for i in range(56):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        weekend = day.weekday() >= 5
        rows += [(day, "seasonal", 10 + 3 * weekend + rng.gauss(0, 0.1)), (day, "flat", 5 + rng.gauss(0, 0.1)), (day, "dead_like", 0.2 + rng.gauss(0, 0.01)), (day, "constant", 1.0), (day, "unknown", 1.0)]
    return spark.createDataFrame(rows, "date date, feature string, value double")


DIRECTIONS = [("seasonal", 1), ("flat", 1), ("dead_like", -1), ("constant", 1)]


def test_detector(spark, daily56, tmp_path):
    state = anomaly.fit_detector(daily56, DIRECTIONS)
    assert {r["feature"]: r["use_dow"] for r in state.collect()} == {"seasonal": True, "flat": False, "dead_like": False, "constant": False}
    saturday = dt.date(2024, 3, 2)
    cases = [("seasonal", 13.0, False), ("seasonal", 10.0, True), ("flat", 4.0, True), ("flat", 6.0, False), ("dead_like", 0.35, True), ("dead_like", 0.05, False), ("flat", None, False)]
    days = spark.createDataFrame([(saturday, f, v) for f, v, _ in cases], "date date, feature string, value double")
    assert sorted((r["feature"], r["value"], r["is_anomaly"]) for r in anomaly.check_days(days, state).where("value is not null").collect()) == sorted(c for c in cases if c[1] is not None)
    assert anomaly.check_days(days, state).where("is_two_sided").count() == 5
    anomaly.save_detector(state, f"{tmp_path}/state")
    loaded = anomaly.load_detector(spark, f"{tmp_path}/state")
    assert sorted(map(tuple, anomaly.check_days(daily56, loaded).collect())) == sorted(map(tuple, anomaly.check_days(daily56, state).collect()))
    state.withColumn("version", F.lit(2)).write.parquet(f"{tmp_path}/other")
    with pytest.raises(Exception, match="version"):
        anomaly.load_detector(spark, f"{tmp_path}/other").collect()
    with pytest.raises(ValueError, match="direction"):
        anomaly.fit_detector(daily56, [("flat", 0)])


def session_rows(spark):
    rows = []
    for day, widget, rate in (("2024-03-01", "web_search_bar", 0.3), ("2024-03-01", "mobile", 0.6), ("2024-03-02", "web_search_bar", 0.1), ("2024-03-02", "mobile", 0.6)):
        t = dt.datetime.fromisoformat(day) + dt.timedelta(hours=9)
        rows += [(i, 1, t, t, widget, i < rate * 100, i % 5, i % 7, i) for i in range(100)]
    return spark.createDataFrame(rows, "user_id long, session_idx long, ts_start timestamp_ntz, ts_end timestamp_ntz, first_widget string, reached_cart boolean, n_unique_queries long, n_view long, duration_s long")


def test_segments(spark):
    table = session_rows(spark)
    broken = segments.segment_breakdown(table).persist()
    got = {(r["segment"], r["value"], r["date"]): r for r in broken.collect()}
    period = got["first_widget", "web_search_bar", "ALL"]
    assert (period["n_sessions"], round(period["success_rate"], 6), round(period["lift_vs_overall"], 6), period["failure_volume"]) == (200, 0.2, -0.2, 160)
    day = got["first_widget", "web_search_bar", "2024-03-02"]
    assert (round(day["success_rate"], 6), round(day["lift_vs_overall"], 6)) == (0.1, -0.25)
    assert ("is_article", "(missing)", "ALL") in got
    weak = segments.weak_spots(broken, min_volume=100).collect()
    assert weak[0]["value"] == "web_search_bar" and all(r["lift_vs_overall"] <= -0.05 for r in weak)
    view = {r["value"]: r for r in segments.segment_day_view(broken.where("segment = 'first_widget'"), "2024-03-02", ("2024-03-01", "2024-03-01"), 50).collect()}
    assert (view["web_search_bar"]["extra_failures"], view["mobile"]["extra_failures"], view["mobile"]["norm_source"]) == (20, 0, "baseline")
    view = {r["value"]: r for r in segments.segment_day_view(broken.where("segment = 'first_widget'"), "2024-03-02", ("2030-01-01", "2030-01-02"), 50).collect()}
    assert (view["web_search_bar"]["extra_failures"], view["web_search_bar"]["norm_source"]) == (10, "period")
    failures = segments.example_failures(table, "first_widget", "web_search_bar", "2024-03-02", 1000)
    assert failures.count() == 90 and "user_id" not in failures.columns
    with pytest.raises(KeyError):
        segments.segment_value(table, "no such column")


def test_enrich(spark, products):
    schema = "user_id long, session_idx long, first_query string, n_unique_queries long, n_click long, reached_cart boolean"
    rows = [(1, 1, "молоко простоквашино", 1, 1, True), (2, 1, " 2 ", 1, 0, False), (3, 1, "a b c d e f g h", 30, 0, False), (4, 1, None, 1, 1, True)]
    got = {r["user_id"]: r for r in enrich.enrich_sessions(spark.createDataFrame(rows, schema), products).collect()}
    assert [got[i]["query_stratification_score"] for i in (1, 2, 3, 4)] == [0, 1, 5, 1]
    assert got[1]["is_in_product_base"] and got[2]["is_article"] and got[4]["query_len_words"] == 0
    assert {r["text"] for r in enrich.catalog_texts(products).collect()} >= {"молоко простоквашино", "елка", "cup"} and enrich.catalog_texts(products).where("text = 'cup'").count() == 1
    with pytest.raises(ValueError, match="lack"):
        enrich.enriched_contract(spark.createDataFrame(rows, schema))


def test_batch_run(spark, sf_dir, tmp_path):
    a = Analysis.of_shop(spark, sf_dir)
    a.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/daily_metrics").count() == 30
    fresh = Analysis(a.events, a.products, a.settings, spark.read.parquet(f"{tmp_path}/sessions"))
    assert fresh.summary.count() == spark.read.parquet(f"{tmp_path}/day_summary").count() == 150
    stored = Analysis.stored(spark, str(tmp_path), a.products)
    assert stored.decomposition.schema["date"].dataType.typeName() == "string"
    for make in (lambda x: rca.day_view(x, "2024-01-25"), lambda x: rca.explain_drop(x, "2024-01-20", "2024-01-25")):
        columns = [c for c in make(stored.decomposition).columns if c != "date"]
        got, want = (sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in make(x.decomposition).select(columns).collect()) for x in (stored, a))
        assert got == want and got
    assert stored.breakdown.count() == a.breakdown.count() and stored.detector.count() == a.detector.count() and stored.metrics.count() == 30
    parts = [f.path for f in sorted(os.scandir(f"{tmp_path}/decomposition"), key=lambda f: f.name) if f.name.endswith(".parquet")]
    rows = [tuple(r) for p in parts for r in spark.read.parquet(p).select(*rca.ORDER).collect()]
    assert rows == sorted(rows, key=lambda r: tuple((x is None, x or "" if i else x) for i, x in enumerate(r))) and len(rows) == a.decomposition.count()


def test_default_baseline(spark, products):
    days = [(1, 86400 * i, "search") for i in range(3, 8)]
    a = Analysis(events(spark, days), products, Settings(baseline_days=3))
    assert a.baseline == ("2024-03-04", "2024-03-06") and health.within(a.daily, *a.baseline).select("date").distinct().count() == 3
    with pytest.raises(ValueError, match="empty"):
        Analysis(events(spark, []), products, Settings()).baseline  # noqa: B018


def test_no_segments_without_sessions(spark, products, tmp_path):
    with pytest.warns(UserWarning, match="not found"):
        assert not write_segments(spark, f"{tmp_path}/none", f"{tmp_path}/out", products)
    session_rows(spark).limit(0).write.parquet(f"{tmp_path}/empty")
    with pytest.warns(UserWarning, match="empty"):
        assert not write_segments(spark, f"{tmp_path}/empty", f"{tmp_path}/out", products)
    assert not (tmp_path / "out").exists()


def test_readers(spark, tmp_path):
    """The log is pruned by date and column, nanoseconds become microseconds; the catalogue and daily files are read."""
    made = events(spark, [(1, 86400 * i, "search" if i % 2 else "view", "q", "w", None if i % 2 else i) for i in range(6)])
    made.withColumn("more", F.lit(1)).write.partitionBy("date", "action_type").parquet(f"{tmp_path}/log")
    read = read_events(spark, f"{tmp_path}/log", "2024-03-02", "2024-03-04")
    assert sorted(r["event_id"] for r in read.collect()) == [1, 2, 3] and tuple(read.columns) == EVENT_COLUMNS
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "more" not in plan
    nanos = spark.createDataFrame([(1_709_251_200_123_456_789,)], "timestamp long")
    assert str(normal_timestamps(nanos).first()["timestamp"]) == "2024-03-01 00:00:00.123456"
    spark.createDataFrame([(1, "n", "b", "t", "c", 5)], "item_id long, name string, brand string, type string, category_name string, price long").write.parquet(f"{tmp_path}/products")
    assert tuple(read_products(spark, f"{tmp_path}/products").columns) == PRODUCT_COLUMNS
    for i in (1, 2):
        spark.createDataFrame([(i, 0.5)], "day long, a double" if i == 1 else "day long, b double").write.parquet(f"{tmp_path}/day{i}")
    daily = read_daily(spark, f"{tmp_path}/day1", f"{tmp_path}/day2")
    assert sorted(daily.columns) == ["a", "b", "day"] and sorted((r["day"], r["a"], r["b"]) for r in daily.collect()) == [(1, 0.5, None), (2, None, 0.5)]


def test_events_without_item_are_dealt_out(spark, products):
    """A catalogue too large to broadcast: the join still gives the same sessions, and no key holds all searches."""
    rows = [(u, 60 * i, "search" if i % 3 else "click", "q", "w", None if i % 3 else 1 + i % 2) for u in range(20) for i in range(30)]
    want = sorted(map(str, sessions.build_sessions(events(spark, rows), products).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, sessions.build_sessions(events(spark, rows), products).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_streaming_sessions(spark, tmp_path):
    rows = [(1, 0, "search"), (1, 2100, "to_cart"), (1, 10_000, "view"), (2, 50, "search"), (9, 200_000, "search")]
    events(spark, rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    query = stream_sessions(stream).writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["user_id"], r["n_events"], r["reached_cart"]) for r in spark.table("sessions_out").collect())
    assert got == [(1, 2, True), (2, 1, False)]
