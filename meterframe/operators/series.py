"""Chart series over bucket results: labels, gap filling and running sums.

These work on bucket rows, which a query has already reduced to one row per bucket
and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.operators.buckets import group_column, group_fields
from meterframe.session import materialize


def humanize(name: str) -> str:
    """`service.tier` as `Service Tier`; only the first letter of a part changes."""
    text = name.removeprefix("metadata.")
    for mark in "._-":
        text = text.replace(mark, " ")
    return " ".join(part[:1].upper() + part[1:] for part in text.split())


def series_label(group_by: str | list[str] | None) -> Column:
    """`Total`, `Ungrouped`, or `Field: value / Field: value`."""
    fields = group_fields(group_by)
    if not fields:
        return F.lit("Total")
    parts = []
    for field in fields:
        value = F.col(group_column(field))
        parts.append(F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{humanize(field)}: "), value)))
    # concat_ws skips NULL parts.
    label = F.concat_ws(" / ", *parts)
    return F.when(label == "", F.lit("Ungrouped")).otherwise(label)


def with_series(bucket_rows: DataFrame, group_by: str | list[str] | None = None) -> DataFrame:
    """Bucket rows as `(series, bucket_start, quantity)`."""
    return (
        bucket_rows.select(series_label(group_by).alias("series"), "bucket_start", "quantity")
        .groupBy("series", "bucket_start")
        .agg(F.sum("quantity").alias("quantity"))
    )


def gap_fill(series_rows: DataFrame) -> DataFrame:
    """Every series on every observed bucket, missing points as 0.

    The axis is the set of observed buckets. Its length, like the number of points of
    one series, is bounded by the query range and bucket size, not by the event count.
    It reaches the series as a scalar subquery; the points come by an equi join. The rows
    are written first, because the axis, the series and the points read them.
    """
    series_rows = materialize(series_rows, "series")
    axis = series_rows.agg(F.array_sort(F.collect_set("bucket_start"))).scalar()
    dense = series_rows.select("series").distinct().select("series", F.explode(axis).alias("bucket_start"))
    filled = dense.join(series_rows, ["series", "bucket_start"], "left")
    return filled.select("series", "bucket_start", F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def cumulative(series_rows: DataFrame) -> DataFrame:
    """Running sum per series in bucket order."""
    window = (
        Window.partitionBy("series")
        .orderBy("bucket_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return series_rows.withColumn("quantity", F.sum("quantity").over(window))
