"""Per-meter, per-subject and per-workspace statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meter_event_stats(events: DataFrame) -> DataFrame:
    """Event count and newest event time per meter."""
    return events.groupBy("workspace_id", "meter_name").agg(
        F.count(F.lit(1)).alias("usage_events"),
        F.max("event_time").alias("last_event_at"),
    )


def meter_stats(events: DataFrame, meters: DataFrame) -> DataFrame:
    """Every meter with its retention and its event statistics (0 when unused).

    The event side is reduced to one row per meter before the join.
    """
    stats = meter_event_stats(events)
    return meters.select(
        "workspace_id", F.col("name").alias("meter_name"), "event_retention_days"
    ).join(stats, ["workspace_id", "meter_name"], "left").select(
        "workspace_id",
        "meter_name",
        "event_retention_days",
        F.coalesce("usage_events", F.lit(0)).cast("long").alias("usage_events"),
        "last_event_at",
    )


def subject_stats(events: DataFrame) -> DataFrame:
    """Event count, exact number of distinct meters and newest event per subject.

    Two steps instead of `count(distinct)`: the first collapses the events to one row
    per (subject, meter), so a hot subject shuffles at most one row per meter and task.
    """
    per_meter = events.groupBy("workspace_id", "subject", "meter_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last_event_at")
    )
    return per_meter.groupBy("workspace_id", "subject").agg(
        F.sum("n").alias("usage_events"),
        F.count(F.lit(1)).alias("meters"),
        F.max("last_event_at").alias("last_event_at"),
    )


def workspace_stats(events: DataFrame, meters: DataFrame, prune_runs: DataFrame | None = None) -> DataFrame:
    """Totals per workspace: events, meters, prune runs and the last prune run."""
    parts = [
        events.groupBy("workspace_id").agg(
            F.count(F.lit(1)).alias("usage_events"),
            F.lit(0).cast("long").alias("meters"),
            F.lit(0).cast("long").alias("prune_runs"),
            F.lit(None).cast("timestamp_ntz").alias("last_prune_at"),
        ),
        meters.groupBy("workspace_id").agg(
            F.lit(0).cast("long").alias("usage_events"),
            F.count(F.lit(1)).alias("meters"),
            F.lit(0).cast("long").alias("prune_runs"),
            F.lit(None).cast("timestamp_ntz").alias("last_prune_at"),
        ),
    ]
    if prune_runs is not None:
        parts.append(
            prune_runs.groupBy("workspace_id").agg(
                F.lit(0).cast("long").alias("usage_events"),
                F.lit(0).cast("long").alias("meters"),
                F.count(F.lit(1)).alias("prune_runs"),
                F.max("created_at").alias("last_prune_at"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("workspace_id").agg(
        F.sum("usage_events").alias("usage_events"),
        F.sum("meters").alias("meters"),
        F.sum("prune_runs").alias("prune_runs"),
        F.max("last_prune_at").alias("last_prune_at"),
    )


def recent_totals(runs: DataFrame, limit: int) -> DataFrame:
    """Accepted and failed events over the newest `limit` ingestion runs."""
    recent = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return recent.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
    )
