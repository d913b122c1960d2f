"""Continuous ingest: landed response files to items and a poll log, and a bounded re-delivery filter."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators import ingest
from feedloom.operators.poll import read_responses
from feedloom.session import scratch, stored
from feedloom.sources.tables import Table

POLL_LOG = "poll_id bigint, feed_id bigint, polled_at timestamp, status string, n_items int"


def ingest_batch(fetches: DataFrame, items: Table, verdicts: DataFrame, polls: Table, stream: str, batch_id: int, **limits) -> None:
    """One micro-batch: read the responses, insert what is new, log the polls. A repeated batch writes its rows again in
    their own place. Stored keys are read for the batch's feeds only, and what the batch stored meanwhile goes. Bodies are read from
    where they landed and entries from their parsed responses, so neither is written once more."""
    batch = f"{stream}-{batch_id}"
    with scratch(fetches.sparkSession):
        outcomes, entries = read_responses(fetches, **limits)
        when = stored(fetches.select("fetch_id", "feed_id", "fetched_at"))
        known = items.of_keys(when.select("feed_id"), without=batch)
        when = when.drop("feed_id")
        fresh = stored(ingest.new_items(entries, known, verdicts, ["feed_id", "fetch_id"], bounded=True))
        rows = ingest.with_ids(fresh, items.read(without=batch)).join(when, "fetch_id").withColumns({
            "is_read": F.lit(0), "is_starred": F.lit(0), "read_at": F.lit(None).cast("timestamp")})
        items.put(rows, batch)
        log = outcomes.join(when, "fetch_id").select(
            F.xxhash64("fetch_id").alias("poll_id"), "feed_id", F.col("fetched_at").alias("polled_at"), "status",
            F.col("n_items").cast("int").alias("n_items"))
        polls.put(log, batch)


def start_ingest(fetches: DataFrame, items: Table, verdicts: DataFrame, polls: Table, checkpoint: str,
                 stream: str = "ingest", limits: dict | None = None, **trigger) -> StreamingQuery:
    """``fetches`` is a stream of responses; by default it drains what has landed and stops. ``limits`` are those of ``read_responses``."""
    run = lambda batch, batch_id: ingest_batch(batch, items, verdicts, polls, stream, batch_id, **(limits or {}))
    return (fetches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def drop_redelivered(entries: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Entries not seen within ``delay``: a state-bounded filter before the insert, which stays the authority."""
    return entries.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["feed_id", "guid"])
