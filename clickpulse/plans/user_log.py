"""A stored layout of the event log for everything that reads it by user.

    root/quiet       events in buckets by user, sorted by user and time: windows and groups by user need no exchange
    root/busy        events of busy users, which a bucket couldn't hold; these are read in blocks of time
    root/users/<n>   the busy users that an append found
    root/log/*.json  what was appended, a small file each

Rows name the append that wrote them, and an append counts once its small file is there. So what a failed append has written is never
read, and both tables change at once for readers.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sessions
from ..operators.sessions import BLOCK_S, BUSY_LEAST, BUSY_SHARE, GAP_MIN
from ..sources.events import EVENT_COLUMNS
from ..sources.folders import write_file


class UserLog:
    """The log under ``root``, a folder that driver and executors share. One writer at a time.

    ``buckets``: as many as shuffle partitions, if nothing is said; what the first append took stays. ``share, least``: who is busy, see
    :func:`~..operators.sessions.busy_users`. A user counts as busy once they were so in the whole log at an append, and all their events are
    then read apart, those in buckets included. While the log doubles, at most ``2 * share`` users can become busy, so the list is short.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, share: int = BUSY_SHARE, least: int = BUSY_LEAST):
        self.spark, self.root, self.share, self.least = spark, root, share, least
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._table = f"user_log_{hashlib.sha256(root.encode()).hexdigest()[:16]}"

    def appends(self) -> list[dict]:
        """What was appended, in order: ``name, until, buckets, schema`` (DDL of the stored rows)."""
        try:
            files = self.spark.read.text(f"{self.root}/log/*.json", wholetext=True)
        except AnalysisException:  # nothing appended yet
            return []
        return sorted((json.loads(r["value"]) for r in files.collect()), key=lambda a: a["name"])  # one small file per append

    def append(self, events: DataFrame) -> dict:
        """Adds ``events``, whose days come after those stored; returns what readers see of it.

        The new events are shuffled once, by user, into one file per bucket. Busy users are found by counting users in the whole log.
        """
        before = self.appends()
        rows = events.select(*EVENT_COLUMNS)
        span = rows.agg(F.min(F.col("date").cast("string")).alias("first"), F.max(F.col("date").cast("string")).alias("last")).first()
        if span["first"] is None:
            raise ValueError("no events to add")
        if before and span["first"] <= before[-1]["until"]:
            raise ValueError(f"days up to {before[-1]['until']} are stored already; these events start on {span['first']}")
        name = f"{len(before) + 1:06d}-{uuid.uuid4().hex[:8]}"
        stored = rows.withColumn("_append", F.lit(name))
        made = {"name": name, "until": span["last"], "buckets": before[0]["buckets"] if before else self._buckets, "schema": before[0]["schema"] if before else stored.schema.toDDL()}
        everyone = rows.select("user_id")
        for part in self._parts(before):
            everyone = everyone.unionByName(part.select("user_id"))
        known = self._busy(before)
        new = [u for u in sessions.busy_users(everyone, self.share, self.least) if u not in known]
        users = StructType([rows.schema["user_id"]])
        self.spark.createDataFrame([(u,) for u in new], users).coalesce(1).write.parquet(f"{self.root}/users/{name}")
        busy = sessions.is_busy(known + new)
        self._register(made)
        stored.where(~busy).repartition(made["buckets"], "user_id").write.insertInto(self._table)
        stored.where(busy).write.mode("append").parquet(f"{self.root}/busy")
        write_file(self.spark, f"{self.root}/log/{name}.json", json.dumps(made))
        return made

    def quiet(self) -> DataFrame:
        """Events of users who aren't busy, in buckets by ``user_id``."""
        appends = self._appended()
        return self._parts(appends)[0].where(~sessions.is_busy(self._busy(appends)))

    def busy(self) -> DataFrame | None:
        """Events of busy users, those included that were stored before they were busy; None without busy users."""
        appends = self._appended()
        users = self._busy(appends)
        if not users:
            return None
        bucketed, apart = self._parts(appends)
        return apart.unionByName(bucketed.where(sessions.is_busy(users)))

    def events(self) -> DataFrame:
        """The whole log, in no order."""
        busy = self.busy()
        return self.quiet() if busy is None else self.quiet().unionByName(busy)

    def number_sessions(self, gap_min: int = GAP_MIN, block_s: int = BLOCK_S) -> DataFrame:
        """:func:`~..operators.sessions.number_sessions` of the whole log; quiet users' events aren't shuffled."""
        rows, busy = sessions.number_sessions(self.quiet(), gap_min, busy=[]), self.busy()
        return rows if busy is None else rows.unionByName(sessions.number_in_blocks(busy, ["user_id"], gap_min, block_s))

    def sessions(self, products: DataFrame, gap_min: int = GAP_MIN, block_s: int = BLOCK_S) -> DataFrame:
        """:func:`~..operators.sessions.build_sessions` of the whole log.

        Quiet users' events are shuffled only where the catalogue is too large to broadcast: then by item, and by user again.
        """
        rows, busy = sessions.build_sessions(self.quiet(), products, gap_min, busy=[]), self.busy()
        if busy is None:
            return rows
        return rows.unionByName(sessions.finished(sessions.stitch(sessions.session_pieces(busy, products, gap_min, block_s=block_s), gap_min)))

    def gap_histogram(self, block_s: int = BLOCK_S) -> DataFrame:
        """:func:`~..operators.sessions.gap_histogram` of the whole log; of quiet users' events only counts by bin are shuffled."""
        last = F.lag("timestamp").over(Window.partitionBy("user_id").orderBy("timestamp"))
        bins, busy = sessions.gap_bins(self.quiet().select(F.timestamp_diff("SECOND", last, F.col("timestamp")).alias("gap_s"))), self.busy()
        if busy is None:
            return bins
        return bins.unionByName(sessions.gap_histogram(busy, block_s)).groupBy("log10_gap_bin").agg(F.sum("n").alias("n"))

    def _appended(self) -> list[dict]:
        appends = self.appends()
        if not appends:
            raise ValueError(f"no log under {self.root}")
        return appends

    def _register(self, made: dict) -> None:
        """The session's name for the buckets; files say themselves which bucket they are."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table} ({made['schema']}) USING parquet "
            f"CLUSTERED BY (user_id) SORTED BY (user_id, timestamp, event_id) INTO {made['buckets']} BUCKETS LOCATION '{self.root}/quiet'"
        )

    def _parts(self, appends: list[dict]) -> list[DataFrame]:
        """Both tables' rows of these appends."""
        if not appends:
            return []
        self._register(appends[0])
        self.spark.catalog.refreshTable(self._table)  # another session may have added files
        apart = self.spark.read.schema(appends[0]["schema"]).parquet(f"{self.root}/busy")
        return [t.where(F.col("_append").isin([a["name"] for a in appends])).drop("_append") for t in (self.spark.table(self._table), apart)]

    def _busy(self, appends: list[dict]) -> list:
        if not appends:
            return []
        found = self.spark.read.parquet(*(f"{self.root}/users/{a['name']}" for a in appends))
        return [r["user_id"] for r in found.collect()]  # a few thousand at most, see above
