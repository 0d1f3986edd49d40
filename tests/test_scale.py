"""What lets the analysis grow: blocks of a user, popular queries, added days, counts that merge, order statistics."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickpulse.operators import anomaly, enrich, health, rca, segments, sessions, validation
from clickpulse.plans.store import RunStore
from clickpulse.plans.tables import Analysis, Settings
from clickpulse.plans.user_log import UserLog

EVENTS = "user_id long, date date, timestamp timestamp_ntz, event_id long, action_type string, widget_name string, search_query string, item_id long"
ACTIONS = ("search", "search", "view", "click", "to_cart", "favorite")


def log(spark, n=3000, users=12, days=6, seed=1, hot=True):
    """Random events; with ``hot``, user 0 has a third of them. Times fall on few seconds, so there are many ties."""
    rng, rows = random.Random(seed), []
    start = dt.datetime(2024, 3, 1)
    for i in range(n):
        user = 0 if hot and i % 3 == 0 else rng.choice([None, *range(1, users)])
        t = start + dt.timedelta(seconds=rng.randrange(days * 24) * 3600 + rng.choice([0, 0, 7, 1800, 3599]), microseconds=rng.choice([0, 0, 900_000]))
        action = rng.choice(ACTIONS)
        search = action == "search"
        rows.append((user, t.date(), t, i, action, rng.choice(["w", "v", None]) if search else None, rng.choice(["milk", "Milk ", "tree", "3", None]) if search else None, None if search else rng.randrange(5)))
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def products(spark):
    rows = [(1, "milk", "Brand", "milk", "dairy"), (2, "tree", None, "tree", "home"), (3, "cup", "b", "cup", "home")]
    return spark.createDataFrame(rows, "item_id long, name string, brand string, type string, category_name string")


def texts(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def settings_of(spark):
    """Sets options of the session for one test."""
    before = {}

    def put(**options):
        for name, value in options.items():
            name = name.replace("__", ".")
            before[name] = spark.conf.get(name)
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("chunk_days", [None, 2])
def test_blocks_number_sessions_like_one_window_per_user(spark, chunk_days):
    events = log(spark)
    keys = ["user_id"]
    whole = events
    if chunk_days:
        keys.append("chunk_start")
        whole = events.withColumn("chunk_start", F.date_sub("date", F.pmod(F.datediff("date", F.lit("2024-03-01").cast("date")), F.lit(chunk_days))))
    by = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    whole = whole.withColumn("gap_s", F.timestamp_diff("SECOND", F.lag("timestamp").over(by), F.col("timestamp")))
    starts = F.when(F.col("gap_s").isNull() | (F.col("gap_s") > 35 * 60), 1).otherwise(0)
    want = texts(whole.withColumn("session_idx", F.sum(starts).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    for block_s in (60, 3600, 40 * 86400):
        for busy in ([None, *range(12)], [0, 3]):
            assert texts(sessions.number_sessions(events, chunk_days=chunk_days, block_s=block_s, busy=busy)) == want


def test_sessions_and_gaps_do_not_depend_on_the_blocks(spark, products):
    events = log(spark, seed=2)
    want, gaps = texts(sessions.build_sessions(events, products)), texts(sessions.gap_histogram(events, 40 * 86400))
    assert len(want) > 100
    for block_s in (600, 3600):
        for busy in ([None, *range(12)], [0, None]):
            assert texts(sessions.build_sessions(events, products, block_s=block_s, busy=busy)) == want
        assert texts(sessions.gap_histogram(events, block_s)) == gaps


def test_a_user_with_a_third_of_all_events_is_many_tasks(spark, products, settings_of):
    settings_of(spark__sql__shuffle__partitions="40", spark__sql__adaptive__coalescePartitions__enabled="false")
    events = log(spark, n=6000)
    assert sessions.busy_users(events) == [] and sessions.busy_users(events, 4, 100) == [0] and len(sessions.busy_users(events, 1000, 100)) == 13
    numbered = sessions.number_sessions(events, busy=sessions.busy_users(events, 1000, 100))
    sizes = [r["n"] for r in numbered.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 600  # the user has 2,000
    assert sessions.build_sessions(events, products, busy=[0]).count() > 100


def test_a_popular_query_and_sessions_without_one_are_dealt_out(spark, products, settings_of):
    rows = [(i, 1, "  MILK" if i % 3 == 0 else None if i % 3 == 1 else f"q{i}" if i % 2 else "3", 1, 0, False) for i in range(6000)]
    made = spark.createDataFrame(rows, "user_id long, session_idx long, first_query string, n_unique_queries long, n_click long, reached_cart boolean")
    want = texts(enrich.enrich_sessions(made, products))
    settings_of(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="40", spark__sql__adaptive__coalescePartitions__enabled="false")
    got = enrich.enrich_sessions(made, products, popular=["milk", "3"])
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_article")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 500  # each of both groups has 2,000
    assert texts(got) == want
    flags = {r["query_clean"]: (r["is_in_product_base"], r["is_article"]) for r in got.collect()}
    assert flags["milk"] == (True, False) and flags["3"] == (False, True) and flags[None] == (False, False) and flags["q5"] == (False, False)
    queries = made.select(F.trim(F.lower("first_query")).alias("query_clean"))
    assert enrich.popular_queries(queries) == [] and enrich.popular_queries(queries, 1000, 100) == ["milk", "3"] and enrich.popular_queries(queries, 4, 100) == ["milk"]
    assert enrich.enrich_sessions(made.limit(0), products).count() == 0


def test_events_without_an_item_are_many_tasks(spark, products, settings_of):
    """The key that deals them out is one that Spark can't take apart."""
    settings_of(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = sessions.session_pieces(log(spark, n=30), products)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 1 and joins[0].count("_key#") == 2 and sum("hashpartitioning(cast(_key#" in line for line in plan.splitlines()) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_quiet_users_are_grouped_once_by_plain_keys(spark, products):
    events = log(spark, n=900, seed=5)
    quiet, blocks = sessions.session_pieces(events, products, 300, busy=[]), sessions.session_pieces(events, products, 300, block_s=10**10)
    same = lambda df: texts(df.withColumns({"queries": F.array_sort("queries"), "categories": F.array_sort("categories")}))
    assert same(quiet) == same(blocks)
    assert same(sessions.whole_pieces(quiet)) == same(sessions.stitch(blocks, 300))
    assert same(sessions.session_pieces(events, products, 300, busy=[0, None]).where("_owner.user_id > 0")) == same(quiet.where("_owner.user_id > 0"))
    groupings = [line for line in plan_of(quiet).splitlines() if "HashAggregate(" in line or "SortAggregate(" in line]
    assert len(groupings) == 2 and not any("_owner" in line for line in groupings)  # a partial and a final one


def test_the_catalogue_is_shuffled_once_to_be_matched(spark, products):
    assert plan_of(enrich.catalog_matches(products)).count("Exchange hashpartitioning") == 1
    got = {(r["query_clean"], r["is_in_product_base"], r["is_article"]) for r in enrich.catalog_matches(products.unionByName(products.withColumn("name", F.lit(" 3")))).collect()}
    assert got == {("milk", True, False), ("tree", True, False), ("cup", True, False), ("brand", True, False), ("b", True, False), ("dairy", True, False), ("home", True, False), ("1", False, True), ("2", False, True), ("3", True, True)}


def days(events, first, last):
    return events.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


@pytest.mark.parametrize("cuts", [("2024-03-03",), ("2024-03-01", "2024-03-02", "2024-03-05")])
def test_added_days_equal_one_run(spark, products, tmp_path, cuts):
    events = log(spark, n=900, seed=3)
    settings = Settings(gap_min=300)
    store = RunStore(spark, str(tmp_path / "runs"), settings)
    first = "2024-03-01"
    for last in (*cuts, "2024-03-06"):
        store.append(days(events, first, last), products, tables=False)
        so_far = store.sessions()
        assert texts(so_far.drop("date")) == texts(sessions.build_sessions(days(events, "2024-03-01", last), products, 300))
        assert so_far.where("date is null or date <> to_date(ts_end)").count() == 0
        first = str(dt.date.fromisoformat(last) + dt.timedelta(1))
    with pytest.raises(ValueError, match="stored already"):
        store.append(days(events, "2024-03-06", "2024-03-06"), products)
    with pytest.raises(ValueError, match="no events"):
        store.append(events.limit(0), products)
    with pytest.raises(ValueError, match="chunks"):
        RunStore(spark, str(tmp_path), Settings(chunk_days=2))


def test_a_run_that_fails_halfway_is_never_seen(spark, products, tmp_path, monkeypatch):
    events = log(spark, n=600, seed=4)
    settings = Settings(baseline=("2024-03-01", "2024-03-02"), min_category_sessions=1, min_sessions_per_category=1)
    store = RunStore(spark, str(tmp_path / "runs"), settings)
    with pytest.raises(ValueError, match="no run"):
        store.sessions()
    manifest = store.append(days(events, "2024-03-01", "2024-03-04"), products)
    before = [texts(store.sessions()), texts(store.analysis(products).breakdown), texts(store.analysis().metrics)]
    wrong = spark.createDataFrame([(1,)], "wrong int")
    with monkeypatch.context() as m:
        m.setattr(rca, "additivity_violations", lambda *_: wrong)
        with pytest.raises(ValueError, match="add up"):
            store.append(days(events, "2024-03-05", "2024-03-06"), products)
    assert store.manifest() == manifest
    assert [texts(store.sessions()), texts(store.analysis(products).breakdown), texts(store.analysis().metrics)] == before
    store.append(days(events, "2024-03-05", "2024-03-06"), products)
    added = store.analysis(products)
    plain = Analysis(events, products, settings)
    assert texts(added.breakdown) == texts(plain.breakdown) and texts(added.sessions.drop("date")) == texts(plain.sessions)
    assert added.metrics.count() == plain.metrics.count() == 6 and added.summary.count() == plain.summary.count() and added.detector.count() == plain.detector.count()
    store.rebuild(days(events, "2024-03-01", "2024-03-05"), products, tables=False)
    assert texts(store.sessions().drop("date")) == texts(sessions.build_sessions(days(events, "2024-03-01", "2024-03-05"), products))
    store.append(days(events, "2024-03-06", "2024-03-06"), products, tables=False)
    assert texts(store.sessions().drop("date")) == texts(plain.sessions)
    with pytest.raises(ValueError, match="tables"):
        store.analysis()


@pytest.mark.parametrize(("share", "least"), [(1000, 10**9), (4, 100), (1000, 20)])
def test_a_log_by_user_gives_what_the_raw_log_gives(spark, products, tmp_path, share, least):
    """With no busy user, with one, and with users who become busy by a later append."""
    events = log(spark, n=600, seed=7)
    stored = UserLog(spark, str(tmp_path / "log"), 4, share, least)
    with pytest.raises(ValueError, match="no log"):
        stored.events()
    first, found = "2024-03-01", []
    for last in ("2024-03-01", "2024-03-04", "2024-03-06"):
        stored.append(days(events, first, last))
        so_far = days(events, "2024-03-01", last)
        found.append(len(stored._busy(stored.appends())))
        fresh = UserLog(spark, stored.root)  # of another reader, who doesn't know the number of buckets
        assert texts(fresh.events()) == texts(so_far)
        assert texts(fresh.sessions(products, 300)) == texts(sessions.build_sessions(so_far, products, 300))
        first = str(dt.date.fromisoformat(last) + dt.timedelta(1))
    assert texts(stored.number_sessions(300)) == texts(sessions.number_sessions(events, 300))
    assert texts(stored.gap_histogram()) == texts(sessions.gap_histogram(events))
    assert found == sorted(found) and (found[-1] == 0) == (least == 10**9) and (least != 20 or found[0] < found[-1])
    with pytest.raises(ValueError, match="stored already"):
        stored.append(days(events, "2024-03-06", "2024-03-06"))
    with pytest.raises(ValueError, match="no events"):
        stored.append(events.limit(0))


def test_an_append_that_fails_is_never_seen(spark, products, tmp_path, monkeypatch):
    from clickpulse.plans import user_log

    events = log(spark, n=300, seed=8)
    stored = UserLog(spark, str(tmp_path / "log"), 4, 4, 50)
    stored.append(days(events, "2024-03-01", "2024-03-03"))
    before = texts(stored.events())

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(user_log, "write_file", lost)  # both tables are written by then
        with pytest.raises(OSError, match="lost"):
            stored.append(days(events, "2024-03-04", "2024-03-06"))
    assert texts(stored.events()) == before
    stored.append(days(events, "2024-03-04", "2024-03-06"))
    assert texts(stored.events()) == texts(events)


def test_readers_of_the_log_by_user_shuffle_no_event(spark, products, tmp_path):
    stored = UserLog(spark, str(tmp_path / "log"), 8)
    stored.append(days(log(spark, n=600, seed=9), "2024-03-01", "2024-03-03"))
    stored.append(days(log(spark, n=600, seed=9), "2024-03-04", "2024-03-06"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(stored.number_sessions())
    products.write.parquet(str(tmp_path / "products"))
    built = plan(stored.sessions(spark.read.parquet(str(tmp_path / "products"))))
    assert built.count("Exchange") == built.count("BroadcastExchange") == 1  # the catalogue
    assert plan(stored.gap_histogram()).count("Exchange hashpartitioning") == 1 and "hashpartitioning(user_id" not in plan(stored.gap_histogram())
    assert "SelectedBucketsCount: 8 out of 8" in plan(stored.number_sessions())


def test_counts_of_days_add_up_to_any_window(spark, products):
    rows = enrich.enrich_sessions(sessions.build_sessions(log(spark, seed=5), products).cache(), products)
    counts = segments.segment_counts(rows)
    halves = segments.segment_counts(rows.where("user_id % 2 = 0")).unionByName(segments.segment_counts(rows.where("user_id % 2 = 1 or user_id is null")))
    assert texts(segments.breakdown_of_counts(halves)) == texts(segments.breakdown_of_counts(counts))
    inside = rows.where(F.to_date("ts_end").between("2024-03-02", "2024-03-04"))
    assert texts(segments.breakdown_of_counts(counts, "2024-03-02", "2024-03-04")) == texts(segments.segment_breakdown(inside))
    made = segments.segment_rows(rows).toPandas()
    for r in segments.breakdown_of_counts(counts).where("date = 'ALL'").collect():
        part = made[(made["segment"] == r["segment"]) & (made["value"] == r["value"])]
        assert (r["n_sessions"], r["n_success"]) == (len(part), part["reached_cart"].sum())
        assert (r["median_n_queries"], r["median_n_views"], r["median_time_s"]) == tuple(part[list(segments.MEASURES)].median())


def daily_table(spark, seed=6, n=40):
    rng, rows = np.random.default_rng(seed), []
    for f, size in (("odd", n + 1), ("even", n), ("two", 2), ("one", 1), ("flat", 9)):
        for i in range(size):
            if f != "even" or i % 7 != 3:  # some days are missing
                value = None if i == 5 and f == "odd" else 1.0 if f == "flat" and i else float(rng.choice([1, 2, 2, 3, rng.normal(2, 4)]))
                rows.append((dt.date(2024, 3, 1) + dt.timedelta(i), f, value))
    return spark.createDataFrame(rows, "date date, feature string, value double")


def test_left_out_days_against_numpy(spark):
    daily = daily_table(spark)
    plan = validation.left_out_bands(daily)._jdf.queryExecution().optimizedPlan().toString()
    assert "value" in plan and "other" not in plan
    table = daily.toPandas().dropna()
    got = {(r["feature"], r["date"]): (r["median"], r["sigma"]) for r in validation.left_out_bands(daily).collect()}
    assert len(got) == len(table) - 1  # a single day has no others
    for (feature, date), (median, sigma) in got.items():
        rest = table[(table["feature"] == feature) & (table["date"] != date)]["value"].to_numpy()
        assert median == pytest.approx(np.median(rest)) and sigma == pytest.approx(1.4826 * np.median(np.abs(rest - np.median(rest))))


def test_rolling_bands_against_numpy(spark):
    daily = daily_table(spark)
    bands = validation.rolling_bands(daily, [("odd", 1), ("even", -1), ("two", 1)])
    assert "Join" not in bands._jdf.queryExecution().optimizedPlan().toString()
    table = daily.toPandas()
    for r in bands.collect():
        past = table[(table["feature"] == r["feature"]) & (table["date"] < r["date"]) & (table["date"] >= r["date"] - dt.timedelta(7))]["value"].dropna().to_numpy()
        if len(past) < 3:
            assert (r["n"], r["median"], r["is_anomaly"]) == (0, None, False)
            continue
        median = np.median(past)
        sigma = 1.4826 * np.median(np.abs(past - median))
        assert (r["n"], r["median"], r["sigma"]) == (len(past), pytest.approx(median), pytest.approx(sigma))
        if r["value"] is not None:
            assert r["is_anomaly"] == (r["value"] > median + 3.5 * sigma if r["feature"] == "even" else r["value"] < median - 3.5 * sigma)


def test_detector_as_json(spark, tmp_path):
    daily = daily_table(spark)
    state = anomaly.fit_detector(daily, [("odd", 1), ("even", -1), ("flat", 1)])
    path = f"{tmp_path}/state/detector.json"
    anomaly.save_detector_json(state, path)
    with open(path) as file:
        plain = json.load(file)
    assert list(plain) == ["version", "directions", "k", "dow_means", "use_dow", "thresholds", "global_centers"] and plain["version"] == "v1"
    assert plain["directions"] == {"even": -1, "flat": 1, "odd": 1} and len(plain["dow_means"]["odd"]) == 7 and set(plain["thresholds"]["odd"]) == {"lo", "hi", "median", "mad", "sigma", "n"}
    loaded = anomaly.load_detector_json(spark, path)
    assert texts(loaded) == texts(state) and texts(anomaly.check_days(daily, loaded)) == texts(anomaly.check_days(daily, state))
    with pytest.raises(FileExistsError):
        anomaly.save_detector_json(state, path)
    for old, new, what in (('"v1"', '"v2"', "version v2"),):
        (tmp_path / "other.json").write_text(json.dumps(plain).replace(old, new))
        with pytest.raises(PySparkException, match=what):
            anomaly.load_detector_json(spark, f"{tmp_path}/other.json").collect()
    nan = anomaly.detector_json(state.withColumn("sigma", F.lit(float("nan")))).first()["json"]
    assert json.loads(nan)["thresholds"]["odd"]["sigma"] is None and "NaN" not in nan


def test_scores_out_of_range_and_absent_features(spark, products):
    rows = spark.createDataFrame([("q", 1, True, False, 3), ("r", 1, True, False, 6), ("s", 1, True, False, None)], "query_clean string, query_len_words int, is_in_product_base boolean, is_article boolean, query_stratification_score int")
    assert enrich.required(rows.limit(1)).count() == 1
    for bad in ("r", "s"):
        with pytest.raises(PySparkException, match="score of difficulty"):
            enrich.required(rows.where(F.col("query_clean") == bad)).collect()
    with pytest.raises(ValueError, match="is_article"):
        enrich.required(rows.drop("is_article"))
    summary = spark.createDataFrame([(dt.date(2024, 3, 1), "c", 5, 1, 0.5)], "date date, category string, n_sessions long, is_cart long, bounce_rate double")
    with pytest.warns(UserWarning, match="rate_of_typos"):
        assert health.feature_rows(summary, ("bounce_rate", "rate_of_typos")).count() == 1
