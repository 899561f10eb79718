"""Time-bucket aggregates, plain or grouped."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.aggregates import aggregate
from meterframe.functions.metadata import field_value, strip_prefix
from meterframe.functions.predicates import Filter
from meterframe.functions.timecalc import bucket_seconds, bucket_start, utc_naive
from meterframe.operators.scan import scan
from meterframe.schema import MISSING_GROUP


def group_fields(group_by: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """Group-by fields: comma-separated text or a list, trimmed, without repeats."""
    if not group_by:
        return []
    parts = group_by.split(",") if isinstance(group_by, str) else list(group_by)
    return list(dict.fromkeys(f for f in (strip_prefix(p) for p in parts) if f))


def group_column(field: str) -> str:
    """Result column of a group-by field."""
    return "subject" if field == "subject" else field.replace(".", "_").replace("-", "_")


def buckets(
    events: DataFrame,
    meter: str,
    start: str | datetime,
    end: str | datetime,
    size: str = "day",
    aggregation: str = "sum",
    workspace: str | None = None,
    subject: str | None = None,
    group_by: str | list[str] | None = None,
    filter: Filter | None = None,
    metadata: dict[str, str] | None = None,
    declared_fields: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Aggregate one meter per tumbling UTC bucket, and per group if asked.

    Buckets without events are not emitted. `subject` is the group value when grouping
    by subject, else the queried subject or "". A missing metadata value forms the
    `<nil>` group. `limit` keeps the earliest rows in (bucket, groups) order.
    """
    if utc_naive(start) >= utc_naive(end):
        raise ValueError("from must be before to")
    fields = group_fields(group_by)
    if declared_fields is not None:
        unknown = [f for f in fields if f != "subject" and f not in declared_fields]
        if unknown:
            raise ValueError(f"unknown group by field {unknown[0]!r}")

    rows = scan(events, workspace, meter, subject, start, end, filter, metadata)
    keys = [bucket_start(F.col("event_time"), size).alias("bucket_start")]
    names = [group_column(f) for f in fields]
    for field, name in zip(fields, names):
        value = field_value(field, rows.columns)
        keys.append((value if field == "subject" else F.coalesce(value, F.lit(MISSING_GROUP))).alias(name))

    # A rate is the bucket's event count over its length; the division needs no shuffle.
    measure = aggregate("count" if aggregation == "rate" else aggregation)
    result = rows.groupBy(*keys).agg(measure.alias("quantity"))
    if aggregation == "rate":
        seconds = bucket_seconds(F.col("bucket_start"), size)
        result = result.withColumn("quantity", F.col("quantity") / seconds)
    if "subject" not in names:
        result = result.withColumn("subject", F.lit(subject or ""))
    order = ["bucket_start", *names]
    result = result.select("bucket_start", "subject", *[n for n in names if n != "subject"], "quantity")
    if limit is not None:
        result = result.orderBy(*order).limit(limit)
    return result


def ordered(bucket_rows: DataFrame) -> DataFrame:
    """Buckets in result order: bucket, then group values."""
    return bucket_rows.orderBy(*[c for c in bucket_rows.columns if c != "quantity"])
