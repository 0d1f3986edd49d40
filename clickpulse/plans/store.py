"""Stored runs: days are added to what is there, and a run is seen whole or not at all.

    root/runs/<run>/sessions          sessions that the run finished, by date
    root/runs/<run>/last              each user's last session, as a piece that later events can go on with
    root/runs/<run>/segment_counts    counts by segment of the sessions that the run finished; open_counts: of those that may still go on
    root/runs/<run>/stitched, counted what the tables above are split from; readers don't need it
    root/runs/<run>/day_summary, ...  the tables over all sessions up to the run
    root/manifests/<number>.json      what a reader needs: the runs whose sessions count, the run with the tables, the last day

A run writes into a folder of its own and publishes it by one small file at the end. Until then readers see the run before; what a
failed run has written is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, rca, segments, sessions
from ..operators.anomaly import load_detector
from ..sources.folders import write_file
from .tables import SHOP, Analysis, Settings

_OPEN_TABLES = {"summary": "day_summary", "metrics": "daily_metrics"}


class RunStore:
    """Runs under ``root``, a folder that driver and executors share. One writer at a time; of two, one fails when it publishes."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = SHOP):
        if settings.chunk_days:
            raise ValueError("sessions cut at chunks don't go on from day to day")
        self.spark, self.root, self.settings = spark, root, settings

    def manifest(self) -> dict | None:
        """The last published run, or None."""
        try:
            files = self.spark.read.text(f"{self.root}/manifests/*.json", wholetext=True)
        except AnalysisException:  # nothing published yet
            return None
        found = files.select(F.get_json_object("value", "$.number").cast("int").alias("number"), "value").agg(F.max_by("value", "number").alias("last")).first()
        return json.loads(found["last"]) if found["last"] else None

    def sessions(self) -> DataFrame:
        """All sessions of the published run, with ``date``; those that may still go on as they are so far."""
        return self._sessions(self._published())

    def analysis(self, products: DataFrame | None = None) -> Analysis:
        """The published run; nothing is computed again."""
        manifest = self._published()
        if not manifest["tables"]:
            raise ValueError("no run has written tables")
        run, path = Analysis(None, products, self.settings, self._sessions(manifest)), f"{self.root}/runs/{manifest['tables']}"
        run.__dict__.update({name: self.spark.read.parquet(f"{path}/{table}") for name, table in _OPEN_TABLES.items()})
        counts = [*(f"{r}/segment_counts" for r in manifest["runs"]), f"{manifest['runs'][-1]}/open_counts"]
        run.__dict__["breakdown"] = segments.breakdown_of_counts(self.spark.read.parquet(*(f"{self.root}/runs/{c}" for c in counts)))
        run.__dict__["decomposition"] = rca.load_decomposition(self.spark, f"{path}/decomposition")
        run.__dict__["detector"] = load_detector(self.spark, f"{path}/detector")
        return run

    def append(self, events: DataFrame, products: DataFrame, tables: bool = True) -> dict:
        """Adds the days of ``events`` after the last stored one, and returns the manifest that it publishes.

        Only these days of the log are read. A user's last session, if it lies within a gap of the border, goes on where the
        new events allow it; it counts as finished once it can't. Sessions are numbered on. ``events`` with days that are
        stored already fail the run, as these were finished without them. ``tables``: whether to bring the tables up to date, too;
        they are computed from stored sessions. Counts by segment are always added; sessions keep the matches that the catalogue
        of their run gave.
        """
        before = self.manifest() or {"number": 0, "runs": [], "tables": None, "until": None}
        span = events.agg(F.min(F.col("date").cast("string")).alias("first"), F.max(F.col("date").cast("string")).alias("last")).first()
        if span["first"] is None:
            raise ValueError("no events to add")
        if before["until"] and span["first"] <= before["until"]:
            raise ValueError(f"days up to {before['until']} are stored already; these events start on {span['first']}")
        name = f"{before['number'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/runs/{name}"
        self._write_sessions(events, products, before, span["last"], path)
        self._write_counts(products, path)
        manifest = {"number": before["number"] + 1, "runs": [*before["runs"], name], "tables": before["tables"], "until": span["last"]}
        if tables:
            self._write_tables(manifest | {"tables": name}, products, path)
            manifest["tables"] = name
        self._publish(manifest)
        return manifest

    def rebuild(self, events: DataFrame, products: DataFrame, tables: bool = True) -> dict:
        """Replaces all that is stored by a run over ``events``; readers see the old run until it is whole."""
        before = self.manifest() or {"number": 0}
        fresh = RunStore(self.spark, f"{self.root}/runs/{before['number'] + 1:06d}-{uuid.uuid4().hex[:8]}", self.settings)
        made = fresh.append(events, products, tables)
        inner = fresh.root.rsplit("/", 1)[1] + "/runs/"
        manifest = made | {"number": before["number"] + 1, "runs": [inner + r for r in made["runs"]], "tables": made["tables"] and inner + made["tables"]}
        self._publish(manifest)
        return manifest

    def _published(self) -> dict:
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"no run under {self.root}")
        return manifest

    def _publish(self, manifest: dict) -> None:
        write_file(self.spark, f"{self.root}/manifests/{manifest['number']:06d}.json", json.dumps(manifest))

    def _last(self, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/runs/{manifest['runs'][-1]}/last")

    def _sessions(self, manifest: dict) -> DataFrame:
        whole = self._open(f"{self.root}/runs/{manifest['runs'][-1]}")
        for run in manifest["runs"]:
            whole = whole.unionByName(self._finished(f"{self.root}/runs/{run}", whole))
        return whole

    def _open(self, path: str) -> DataFrame:
        last = self.spark.read.parquet(f"{path}/last").where("_open").withColumnRenamed("_number", "session_idx")
        return sessions.finished(last).withColumn("date", F.to_date("ts_end"))

    def _finished(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{path}/sessions")  # a run may have finished none

    def _write_sessions(self, events: DataFrame, products: DataFrame, before: dict, until: str, path: str) -> None:
        gap_min = self.settings.gap_min
        busy = sessions.busy_users(events)
        quiet = sessions.session_pieces(events.where(~sessions.is_busy(busy)) if busy else events, products, gap_min, busy=[])
        blocks = sessions.session_pieces(events.where(sessions.is_busy(busy)), products, gap_min) if busy else None
        if before["runs"]:
            earlier = self._last(before).select("_owner", F.lit(None).cast("long").alias("_block"), F.lit(0).cast("long").alias("_local"), *sessions.PIECE, "_number")
            pieces = quiet if blocks is None else quiet.unionByName(blocks)
            stitched = sessions.stitch(pieces.withColumn("_number", F.lit(None).cast("long")).unionByName(earlier), gap_min)
        else:  # only busy users have pieces that go on
            stitched = sessions.whole_pieces(quiet)
            if blocks is not None:
                stitched = stitched.unionByName(sessions.stitch(blocks, gap_min))
        # written once, as both tables come from it
        stitched.write.parquet(f"{path}/stitched")
        stitched = self.spark.read.parquet(f"{path}/stitched")
        border = F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz")
        is_open = F.timestamp_diff("SECOND", F.col("ts_end"), border) <= gap_min * 60
        finished = sessions.finished(stitched.where(~is_open)).withColumn("date", F.to_date("ts_end"))
        finished.repartition("date").write.partitionBy("date").parquet(f"{path}/sessions")
        # a row per user; of finished sessions only the number and the end are needed, and without a search they aren't finished twice
        last = stitched.groupBy("_owner").agg(F.max_by(F.struct("session_idx", *sessions.PIECE), "session_idx").alias("s")).select("_owner", "s.*").withColumnRenamed("session_idx", "_number")
        last = last.withColumn("_open", is_open)
        kinds = dict(last.dtypes)
        blank = {c: F.lit(0).cast("long") for c in ("n_events", "n_search", "n_view", "n_click", "n_cart", "n_fav")}
        blank |= {c: F.array().cast(kinds[c]) for c in ("queries", "categories")} | {c: F.lit(None).cast(kinds[c]) for c in ("first_query", "first_widget", "ts_first_cart")}
        last.withColumns({c: F.when(F.col("_open"), F.col(c)).otherwise(value) for c, value in blank.items()}).write.parquet(f"{path}/last")

    def _write_counts(self, products: DataFrame, path: str) -> None:
        open_ = self._open(path)
        is_open = F.col("_open")
        rows = self._finished(path, open_).withColumn("_open", F.lit(False)).unionByName(open_.withColumn("_open", F.lit(True)))
        # both are matched and counted in one pass over the sessions and the catalogue; what is counted is small, and is written once for each
        segments.segment_counts(enrich.required(enrich.enrich_sessions(rows, products)), also=("_open",)).write.parquet(f"{path}/counted")
        counted = self.spark.read.parquet(f"{path}/counted")
        for part, table in ((~is_open, "segment_counts"), (is_open, "open_counts")):
            counted.where(part).drop("_open").write.parquet(f"{path}/{table}")

    def _write_tables(self, manifest: dict, products: DataFrame, path: str) -> None:
        Analysis(None, products, self.settings, self._sessions(manifest)).write_tables(path)
