"""Tenant-scoped scans of the usage-event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.predicates import Filter, meta_text_equals, to_column
from meterframe.functions.timecalc import ntz, utc_naive


def tenant(events: DataFrame, workspace: str, allowed_meters: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one workspace, optionally limited to a meter allow-list (`*` = all)."""
    if not workspace:
        raise ValueError("workspace is required")
    return allowed(events.filter(F.col("workspace_id") == workspace), allowed_meters)


def allowed(events: DataFrame, allowed_meters: tuple[str, ...]) -> DataFrame:
    """Rows of the meters on an allow-list (empty or `*` = all)."""
    if allowed_meters and "*" not in allowed_meters:
        return events.filter(F.col("meter_name").isin(*allowed_meters))
    return events


def in_range(column: Column, start: str | datetime | None, end: str | datetime | None) -> Column:
    """Half-open `[start, end)`; an unset edge adds no predicate."""
    test = F.lit(True)
    if start is not None:
        test = test & (column >= ntz(start))
    if end is not None:
        test = test & (column < ntz(end))
    return test


def scan(
    events: DataFrame,
    workspace: str | None = None,
    meter: str | None = None,
    subject: str | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    filter: Filter | None = None,
    metadata: dict[str, str] | None = None,
    allowed_meters: tuple[str, ...] = (),
) -> DataFrame:
    """Usage events of one workspace; unset or empty arguments add no predicate.

    Stored events carry an `event_date` partition column: the time range then also
    prunes partitions.
    """
    if workspace is not None:
        events = tenant(events, workspace, allowed_meters)
    else:
        events = allowed(events, allowed_meters)
    if meter:
        events = events.filter(F.col("meter_name") == meter)
    if subject:
        events = events.filter(F.col("subject") == subject)
    if "event_date" in events.columns:
        if start is not None:
            events = events.filter(F.col("event_date") >= F.lit(utc_naive(start).date()))
        if end is not None:
            last = utc_naive(end) - timedelta(microseconds=1)
            events = events.filter(F.col("event_date") <= F.lit(last.date()))
    events = events.filter(in_range(F.col("event_time"), start, end))
    if metadata:
        events = events.filter(meta_text_equals(metadata, events.columns))
    if filter is not None:
        events = events.filter(to_column(filter, events.columns))
    return events
