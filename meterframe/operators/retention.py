"""Per-meter retention: cutoffs, dry run, kept rows and the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz
from meterframe.operators.joins import side_join
from meterframe.schema import RETENTION_DEFAULT_DAYS


def cutoffs(meters: DataFrame, now: str | datetime) -> DataFrame:
    """`now` minus the meter's retention in calendar days."""
    days = F.when(F.coalesce("event_retention_days", F.lit(0)) == 0, RETENTION_DEFAULT_DAYS).otherwise(
        F.col("event_retention_days")
    )
    return meters.select(
        "workspace_id",
        F.col("name").alias("meter_name"),
        (ntz(now) - F.make_dt_interval(days=days)).alias("cutoff"),
    )


def prunable_counts(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Events strictly before the cutoff, per meter; meters without any show 0."""
    keys = ["workspace_id", "meter_name"]
    old = side_join(events, cuts, keys, residual=F.col("event_time") < F.col("cutoff"))
    counted = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("deleted"))
    return cuts.join(counted, keys, "left").select(
        *keys, F.col("cutoff").alias("before"), F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted")
    )


def kept_events(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Events that survive pruning; events of unknown meters are kept."""
    joined = side_join(events, cuts, ["workspace_id", "meter_name"], "left")
    return joined.filter(F.col("cutoff").isNull() | (F.col("event_time") >= F.col("cutoff"))).drop("cutoff")


def prune_run(counts: DataFrame, dry_run: bool, run_id: str, now: str | datetime) -> DataFrame:
    """One log row per workspace; the meter list has one entry per defined meter."""
    entry = F.struct("meter_name", "before", "deleted")
    return counts.groupBy("workspace_id").agg(
        F.sum("deleted").alias("deleted"), F.array_sort(F.collect_list(entry)).alias("meters")
    ).select(
        F.concat_ws("/", F.lit(run_id), "workspace_id").alias("id"),
        "workspace_id",
        F.lit(dry_run).alias("dry_run"),
        "deleted",
        "meters",
        ntz(now).alias("created_at"),
    )
