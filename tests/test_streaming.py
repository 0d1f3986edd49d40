"""Numbered sessions over a stream against the batch form, with events that come late."""

from __future__ import annotations

import datetime as dt
import random

from clickpulse.operators import sessions
from clickpulse.streaming.sessions import stream_numbered_sessions

EVENTS = "user_id long, date date, timestamp timestamp_ntz, event_id long, action_type string, widget_name string, search_query string, item_id long"


def test_a_stream_gives_the_sessions_of_the_batch(spark, tmp_path):
    rng, rows, start = random.Random(8), [], dt.datetime(2024, 3, 1)
    for i in range(240):
        t = start + dt.timedelta(seconds=i * 240 + rng.choice([0, 0.9, 2100, -1500]))
        action = rng.choice(["search", "view", "click", "to_cart", "favorite"])
        search = action == "search"
        rows.append((rng.randrange(4), t.date(), t, i, action, rng.choice(["w", None]) if search else None, rng.choice(["a", "b", None]) if search else None, None if search else rng.randrange(4)))
    products = spark.createDataFrame([(1, "home"), (2, "dairy"), (3, "home")], "item_id long, category_name string")
    want = sessions.build_sessions(spark.createDataFrame(rows, EVENTS), products)
    far = [(9, dt.date(2024, 4, 1), dt.datetime(2024, 4, 1) + dt.timedelta(hours=h), 1000 + h, "view", None, None, None) for h in (0, 9)]
    # three files, in the order of arrival: within one, and from one to the next, events are up to an hour out of order
    for n, part in enumerate((rows[:100], rows[100:180], rows[180:], far[:1], far[1:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        out = stream_numbered_sessions(stream, products, late="1 hour")
        run = out.writeStream.format("memory").queryName("numbered").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before[1])
    got = sorted(map(str, spark.table("numbered").select(want.columns).collect()))
    assert got == sorted(map(str, want.collect())) and len(got) > 10
