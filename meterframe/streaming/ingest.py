"""Streaming ingest into the event store, and bounded-state deduplication."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterframe.functions.timecalc import as_instant
from meterframe.sources.store import EventStore


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def batch_name(stream: str, epoch: int) -> str:
    """Batch id of a micro-batch; sorts by epoch."""
    return f"{stream}-{epoch:012d}"


def start_ingest(
    store: EventStore,
    raw: DataFrame,
    meters: DataFrame,
    checkpoint: str,
    stream: str = "stream",
    assignments: DataFrame | None = None,
    after_batch: Callable[[str, datetime], None] | None = None,
    interval: str | None = None,
    clock: Callable[[], datetime] = utc_now,
) -> StreamingQuery:
    """Feed a raw event stream through the same ingest as a batch.

    The micro-batch number names the batch, and the ledger answers a repeated one, so
    a restart neither loses nor doubles events. Late events are accepted without
    bound. `after_batch` runs quota and alert evaluation on the committed batch.
    Without `interval` the query drains what is there and stops.
    """

    def run(rows: DataFrame, epoch: int) -> None:
        batch_id, now = batch_name(stream, epoch), clock()
        store.ingest(rows, meters, batch_id, now, kind="stream", assignments=assignments)
        if after_batch is not None:
            after_batch(batch_id, now)

    writer = raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def drop_repeats_within(events: DataFrame, delay: str) -> DataFrame:
    """Deduplicate by idempotency key with state that expires after `delay`.

    The opt-in alternative to the exact key table: memory stays bounded, but a repeat
    that comes later than `delay` after the first event time is accepted again. Events
    without a key never repeat one another: they pass beside the state.
    """
    has_key = F.col("idempotency_key").isNotNull()
    timed = events.filter(has_key).withColumn("event_instant", as_instant(F.col("event_time")))
    kept = timed.withWatermark("event_instant", delay).dropDuplicatesWithinWatermark(
        ["workspace_id", "idempotency_key"]
    )
    return kept.drop("event_instant").unionByName(events.filter(~has_key))
