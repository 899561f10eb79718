"""Whole-range aggregates: scalar, per value (top-k), and distinct values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.aggregates import aggregate
from meterframe.functions.metadata import field_value, strip_prefix
from meterframe.functions.predicates import Filter
from meterframe.functions.timecalc import utc_naive
from meterframe.operators.scan import scan
from meterframe.session import materialize


def _range_seconds(start, end):
    return F.lit((utc_naive(end) - utc_naive(start)).total_seconds())


def aggregate_range(
    events: DataFrame,
    meter: str,
    start: str | datetime,
    end: str | datetime,
    aggregation: str = "sum",
    workspace: str | None = None,
    subject: str | None = None,
    metadata: dict[str, str] | None = None,
    filter: Filter | None = None,
) -> DataFrame:
    """One row `(quantity, usage_events)`; both are 0 when no event matches."""
    rows = scan(events, workspace, meter, subject, start, end, filter, metadata)
    return rows.agg(
        aggregate(aggregation, _range_seconds(start, end)).alias("quantity"),
        F.count(F.lit(1)).alias("usage_events"),
    ).select(F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "usage_events")


def breakdown(
    events: DataFrame,
    meter: str,
    field: str,
    start: str | datetime,
    end: str | datetime,
    aggregation: str = "sum",
    workspace: str | None = None,
    subject: str | None = None,
    filter: Filter | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Aggregate per subject or metadata value; missing and empty values drop out.

    `limit` makes it a top-k by quantity (ties by value), which Spark runs as a
    per-partition top-k followed by a merge.
    """
    rows = scan(events, workspace, meter, subject, start, end, filter)
    result = (
        rows.select(field_value(field, rows.columns).alias("value"), "quantity", "event_time", "id")
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("value")
        .agg(
            aggregate(aggregation, _range_seconds(start, end)).alias("quantity"),
            F.count(F.lit(1)).alias("usage_events"),
        )
    )
    if limit is not None:
        result = result.orderBy(F.desc("quantity"), F.asc("value")).limit(limit)
    return result


def dimension_values(
    events: DataFrame,
    meter: str,
    field: str,
    workspace: str | None = None,
    subject: str | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct values of a metadata field with their event counts."""
    if strip_prefix(field) == "subject":
        raise ValueError("dimension values need a metadata field")
    rows = scan(events, workspace, meter, subject, start, end)
    result = (
        rows.select(field_value(field, rows.columns).alias("value"))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("usage_events"))
    )
    if limit is not None:
        result = result.orderBy(F.desc("usage_events"), F.asc("value")).limit(limit)
    return result


def share_of_max(items: DataFrame, floor: float = 4.0) -> DataFrame:
    """Each item's quantity as a percentage of the largest one, at least `floor`.

    The items are written first, so the events behind them are read once; the maximum
    is a scalar subquery over them: no window over the whole result and no join.
    """
    items = materialize(items, "breakdown")
    top = items.agg(F.max("quantity")).scalar()
    share = F.greatest(F.lit(floor), F.col("quantity") / top * 100)
    return items.withColumn("share", F.when(top <= 0, F.lit(floor)).otherwise(share))
