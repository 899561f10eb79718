"""Windowed aggregates over streams.

Hour and day buckets and alert look-back windows are standing queries with a
watermark. Month buckets, and any bucket that must take events however late, go
through partials in a table: each micro-batch appends its own, and a read merges them.
The partials also give the windows that the watermark has not closed yet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterframe.functions.aggregates import aggregate, merge_partials, partial_of_events, partial_value
from meterframe.functions.timecalc import as_instant, bucket_start, from_instant, plus_seconds

WINDOW_LENGTH = {"hour": "1 hour", "day": "1 day"}
SECONDS = {"hour": 3600, "day": 86400}


def _windowed(events: DataFrame, lateness: str, window: list[str], group_by: list[str], aggregation: str) -> DataFrame:
    # Watermarks need an instant; the event time itself is a UTC wall-clock value.
    timed = events.withColumn("event_instant", as_instant(F.col("event_time")))
    return (
        timed.withWatermark("event_instant", lateness)
        .groupBy(F.window("event_instant", *window).alias("w"), *group_by)
        .agg(aggregate(aggregation).alias("quantity"), F.count(F.lit(1)).alias("usage_events"))
    )


def tumbling(events: DataFrame, size: str, lateness: str, group_by: list[str], aggregation: str = "sum") -> DataFrame:
    """Hour or day buckets of a stream, final once the watermark passes."""
    rows = _windowed(events, lateness, [WINDOW_LENGTH[size]], group_by, aggregation)
    return rows.select(from_instant(F.col("w.start")).alias("bucket_start"), *group_by, "quantity", "usage_events")


def sliding(
    events: DataFrame, length: str, slide: str, lateness: str, group_by: list[str], aggregation: str = "sum"
) -> DataFrame:
    """Look-back windows `[tick - length, tick)` at every slide."""
    rows = _windowed(events, lateness, [length, slide], group_by, aggregation)
    return rows.select(from_instant(F.col("w.end")).alias("tick_at"), *group_by, "quantity", "usage_events")


def start_bucket_partials(
    events: DataFrame, size: str, group_by: list[str], path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append each micro-batch's bucket partials; a repeated batch replaces its own."""

    def run(rows: DataFrame, epoch: int) -> None:
        bucket = bucket_start(F.col("event_time"), size).alias("bucket_start")
        partials = rows.groupBy(bucket, *group_by).agg(*partial_of_events())
        partials.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(path)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def read_bucket_partials(spark: SparkSession, path: str, group_by: list[str]) -> DataFrame:
    """Buckets from all appended partials."""
    return spark.read.parquet(path).groupBy("bucket_start", *group_by).agg(*merge_partials())


def tumbling_of_partials(partials: DataFrame, size: str, group_by: list[str], aggregation: str = "sum") -> DataFrame:
    """The rows of `tumbling` as far as the partials go, open hours or days included."""
    value = partial_value(F.lit(aggregation), F.lit(float(SECONDS[size])))
    return partials.select("bucket_start", *group_by, value.alias("quantity"), F.col("event_count").alias("usage_events"))


def sliding_of_partials(
    partials: DataFrame, size: str, buckets: int, group_by: list[str], aggregation: str = "sum"
) -> DataFrame:
    """The rows of `sliding` for windows of `buckets` buckets and a slide of one, open windows included."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(buckets)))
    tick_at = plus_seconds(F.col("bucket_start"), F.col("ahead") * SECONDS[size])
    spread = partials.withColumn("ahead", ahead).withColumn("tick_at", tick_at)
    value = partial_value(F.lit(aggregation), F.lit(float(buckets * SECONDS[size])))
    return (
        spread.groupBy("tick_at", *group_by)
        .agg(*merge_partials())
        .select("tick_at", *group_by, value.alias("quantity"), F.col("event_count").alias("usage_events"))
    )


def with_open_windows(closed: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """What a standing query has emitted, and the windows it still holds back from the partials."""
    emitted = closed.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return closed.unionByName(windows.join(emitted, same, "left_anti"))
