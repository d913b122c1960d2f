"""A poll stream: each micro-batch of landed responses is one poll over its feeds, and leaves every table once."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators import state
from feedloom.operators.poll import poll_cycle
from feedloom.schemas import FEEDS, ITEMS, RETAIN_PER_FEED, RUNS, VERDICTS
from feedloom.session import scratch, stored
from feedloom.sources.tables import FEED_BUCKETS, Snapshots, Table


@dataclass
class PollTables:
    """Feeds and items by feed, verdicts by video, and the run log, whose rows are the commits: a version counts once its run is logged.

    The log carries the greatest item id, so no table is read for it.
    """
    feeds: Snapshots
    items: Snapshots
    verdicts: Snapshots
    runs: Table

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = FEED_BUCKETS) -> PollTables:
        return cls(Snapshots(spark, f"{path}/feeds", FEEDS, "feed_id", buckets), Snapshots(spark, f"{path}/items", ITEMS, "feed_id", buckets),
                   Snapshots(spark, f"{path}/verdicts", VERDICTS, "video_id", buckets), Table(spark, f"{path}/runs", f"{RUNS}, last_item_id bigint"))

    def begin(self, feeds: DataFrame, items: DataFrame | None = None, verdicts: DataFrame | None = None) -> None:
        """Version 0: what is known before the stream."""
        last = 0
        for table, given in ((self.feeds, feeds), (self.items, items), (self.verdicts, verdicts)):
            if given is not None:
                table.replace(given, list(range(table.buckets)), 0)
        if items is not None:
            last = items.agg(F.max("item_id")).first()[0] or 0
        self._log(state.failed_run(self.runs.spark, 0, "begin", F.current_timestamp(), F.current_timestamp(), "").withColumn("note", F.lit(None).cast("string")), 0, last)

    def _log(self, record: DataFrame, version: int, last_id: int) -> None:
        self.runs.put(record.withColumn("last_item_id", F.lit(last_id).cast("bigint")), f"run-{version}")

    def committed(self) -> int:
        """The newest version whose run is logged; -1 for none."""
        return self.runs.read().agg(F.coalesce(F.max("run_id"), F.lit(-1))).first()[0]

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Feeds, items and verdicts as the last logged run left them, whatever a batch is writing meanwhile."""
        done = self.committed() + 1
        return self.feeds.as_of(done), self.items.as_of(done), self.verdicts.as_of(done)


def poll_batch(fetches: DataFrame, tables: PollTables, answers: DataFrame, version: int, trigger: str = "stream", cap: int = RETAIN_PER_FEED, **limits) -> None:
    """One micro-batch, as version ``version`` (from 1). Only the buckets of its feeds and of the videos it settles are read
    and written. Its time is the last response's, so that a repeated batch gives the same rows; a batch without rows leaves its
    run record. ``unclassified`` counts the videos of the buckets read, thus of the batch's feeds and their neighbours."""
    spark = fetches.sparkSession
    with scratch(spark):
        fetches = stored(fetches)
        polled = stored(fetches.select("feed_id").distinct())
        now = F.coalesce(F.lit(fetches.agg(F.max("fetched_at")).first()[0]), F.current_timestamp())
        last = tables.runs.read().filter(F.col("run_id") < version).agg(F.max_by("last_item_id", "run_id")).first()[0] or 0
        asked = tables.feeds.asked(polled)
        feeds, items = stored(tables.feeds.as_of(version, asked)), stored(tables.items.as_of(version, asked))
        verdicts = stored(tables.verdicts.as_of(version))
        poll = poll_cycle(fetches, feeds, items, verdicts, answers, now, force=True, cap=cap, last_id=F.lit(last), **limits)
        tables.items.replace(poll.items, asked, version)
        tables.feeds.replace(poll.feeds, asked, version)
        videos = tables.verdicts.asked(poll.settled)
        if videos:
            rows = poll.verdicts.filter(tables.verdicts.bucket().isin(videos))
            tables.verdicts.replace(rows, videos, version)
        record = state.run_record(poll.run, version, trigger, now, now)
        tables._log(stored(record), version, last + poll.fresh.count())


def start_polls(fetches: DataFrame, tables: PollTables, answers: DataFrame, checkpoint: str, limits: dict | None = None, **trigger) -> StreamingQuery:
    """``fetches`` is a stream of responses; by default it drains what has landed and stops. ``limits`` are those of ``read_responses``."""
    run = lambda batch, batch_id: poll_batch(batch, tables, answers, batch_id + 1, **(limits or {}))
    return (fetches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
