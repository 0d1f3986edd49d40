"""Sessions over an unbounded event log: with the built-in session window, and numbered ones with state of their own."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import GAP_MIN, finished


def stream_sessions(events: DataFrame, gap_min: int = GAP_MIN, late: str = "1 hour") -> DataFrame:
    """Sessions with a search, emitted once the watermark has passed their end (append mode).

    A gap of exactly ``gap_min`` minutes stays within a session, as in the batch form; gaps are compared below the
    second here, so a gap that exceeds it by less than a second ends a session here only. Events later than ``late``
    are dropped. Sessions have no number: the key is the user and the start.
    """
    action = F.col("action_type")
    counts = {"n_search": "search", "n_view": "view", "n_click": "click", "n_cart": "to_cart", "n_fav": "favorite"}
    window = F.session_window("timestamp", f"{gap_min} minutes 1 microsecond")
    sessions = (
        events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", late)
        .groupBy("user_id", window.alias("w"))
        .agg(
            F.min("timestamp").alias("ts_start"),
            F.max("timestamp").alias("ts_end"),
            F.count(F.lit(1)).alias("n_events"),
            *[F.count_if(action == kind).alias(name) for name, kind in counts.items()],
            F.min(F.when(action == "to_cart", F.col("timestamp"))).alias("ts_first_cart"),
        )
    )
    return sessions.where("n_search > 0").drop("w").withColumn("reached_cart", F.col("n_cart") > 0)


#: Times are microseconds since 1970, which no time zone of a worker changes.
_EVENT = "at long, event_id long, action_type string, widget_name string, search_query string, category_name string"
_COUNTS = {"search": "n_search", "view": "n_view", "click": "n_click", "to_cart": "n_cart", "favorite": "n_fav"}
_TIMES = ("ts_start", "ts_end", "ts_first_cart")
_PIECE = (
    "user_id long, session_idx long, ts_start long, ts_end long, n_events long, n_search long, n_view long, n_click long, n_cart long, n_fav long, "
    "ts_first_cart long, first_query string, first_widget string, queries array<string>, categories array<struct<category:string,n:long>>"
)
_SECOND = 1_000_000


class NumberedSessions(StatefulProcessor):
    """Of each user: events that earlier ones may still precede, the session that goes on, and its number.

    Events wait until the watermark has passed them, as late ones may come before them; then they are added to the user's session
    in order, and only counts, firsts and distinct values of it are kept. A session is emitted once the watermark is more
    than the gap beyond its last event. So state follows a user's events within the allowed lateness, not the session's.
    """

    def __init__(self, gap_min: int):
        self.gap = (gap_min * 60 + 1) * _SECOND  # gaps count in whole seconds: this one is the first that ends a session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.current = handle.getValueState("current", "number long, session string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [(r.at, r.event_id, r.action_type, r.widget_name, r.search_query, r.category_name) for r in rows]
        self.waiting.appendList(fresh)
        # once the watermark has passed these events they are in order, and a gap later their session is over
        last = max(r[0] for r in fresh)
        for at in (last, last + self.gap):
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        passed = [r for r in waiting if r[0] < mark]
        waiting = waiting[len(passed) :]
        number, packed = self.current.get() if self.current.exists() else (0, None)
        session = json.loads(packed) if packed else None
        for event in passed:
            if session and event[0] - session["ts_end"] >= self.gap:
                yield self._row(key, number, session)
                session = None
            if session is None:
                number, session = number + 1, self._new(event[0])
            self._add(session, event)
        # an event that waits may be the next of this session
        if session and session["ts_end"] + self.gap < mark and (not waiting or waiting[0][0] - session["ts_end"] >= self.gap):
            yield self._row(key, number, session)
            session = None
        if passed and waiting:
            self.waiting.put(waiting)
        elif passed:
            self.waiting.clear()
        self.current.update((number, json.dumps(session) if session else None))

    def close(self) -> None:
        pass

    @staticmethod
    def _new(start: int) -> dict:
        return {"ts_start": start, "n_events": 0, **dict.fromkeys(_COUNTS.values(), 0), "ts_first_cart": None, "first_query": None, "first_widget": None, "queries": {}, "categories": {}}

    @staticmethod
    def _add(session: dict, event: tuple) -> None:
        at, _, action, widget, query, category = event
        session["ts_end"] = at
        session["n_events"] += 1
        if action in _COUNTS:
            session[_COUNTS[action]] += 1
        if action == "to_cart" and session["ts_first_cart"] is None:
            session["ts_first_cart"] = at
        if action == "search":
            for name, value in (("first_query", query), ("first_widget", widget)):
                if session[name] is None:
                    session[name] = value
            if query is not None:
                session["queries"][query] = 1
        if category is not None:
            session["categories"][category] = session["categories"].get(category, 0) + 1

    @staticmethod
    def _row(key: tuple, number: int, s: dict) -> Row:
        kept = {c: s[c] for c in (*_TIMES, "n_events", *_COUNTS.values(), "first_query", "first_widget")}
        kept |= {"user_id": key[0], "session_idx": number, "queries": list(s["queries"]), "categories": [Row(category=c, n=n) for c, n in s["categories"].items()]}
        return Row(**{name: kept[name] for name in (f.split()[0] for f in _PIECE.split(", "))})


def stream_numbered_sessions(events: DataFrame, products: DataFrame, gap_min: int = GAP_MIN, late: str = "1 hour") -> DataFrame:
    """All columns of :func:`~..operators.sessions.build_sessions` over a stream, each session once it can't go on (append mode).

    Numbers, first query and widget, categories and gaps in whole seconds are those of the batch form, for events that are at most
    ``late`` behind; later ones are dropped. The catalogue is joined as a static table. Needs the RocksDB state store.
    """
    named = products.where("item_id is not null").select("item_id", "category_name")
    rows = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).join(named, "item_id", "left")
    rows = rows.select("user_id", "timestamp", F.unix_micros("timestamp").alias("at"), "event_id", "action_type", "widget_name", "search_query", "category_name")
    pieces = rows.groupBy("user_id").transformWithState(statefulProcessor=NumberedSessions(gap_min), outputStructType=_PIECE, outputMode="Append", timeMode="EventTime")
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in _TIMES}
    firsts = {c: F.struct(F.col(c).alias("value")) for c in ("first_query", "first_widget")}
    return finished(pieces.withColumns({**times, **firsts, "_owner": F.struct("user_id")}))
