"""CSV sinks with fixed headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import rfc3339
from meterframe.operators.buckets import group_column, group_fields


def plain_number(value: Column) -> Column:
    """Shortest decimal text without an exponent: 9, 2.5, 0.000001.

    The digits are those of the shortest exact text; only the point is moved.
    """
    text = value.cast("string")
    sign = F.regexp_extract(text, r"^(-?)", 1)
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), "0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    digits, point = F.concat(whole, fraction), F.length(whole) + power
    size = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - size))
    split = F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
    shown = F.when(value == 0, "0").when(point <= 0, small).when(point >= size, large).otherwise(split)
    return F.when(text.rlike("^-?[0-9]"), F.concat(sign, shown)).otherwise(text)


def bucket_csv(
    buckets: DataFrame, meter: str, size: str, aggregation: str, unit: str, group_by=None
) -> DataFrame:
    """Bucket rows in the bucket CSV layout, all columns as text."""
    extra = [f for f in group_fields(group_by) if f != "subject"]
    return buckets.select(
        rfc3339(F.col("bucket_start")).alias("bucket_start"),
        "subject",
        F.lit(meter).alias("meter"),
        F.lit(size).alias("bucket_size"),
        F.lit(aggregation).alias("aggregation"),
        F.lit(unit).alias("unit"),
        plain_number(F.col("quantity")).alias("quantity"),
        *[F.col(group_column(f)).alias(f) for f in extra],
    )


def event_csv(events: DataFrame) -> DataFrame:
    """Events in the event CSV layout; metadata as compact JSON text, or as stored if it does not parse."""
    return events.select(
        rfc3339(F.col("event_time")).alias("timestamp"),
        rfc3339(F.col("received_at")).alias("received_at"),
        "subject",
        F.col("meter_name").alias("meter"),
        plain_number(F.col("quantity")).alias("quantity"),
        F.coalesce(F.to_json(F.try_parse_json("metadata")), "metadata", F.lit("{}")).alias("metadata"),
        "id",
        F.coalesce("idempotency_key", F.lit("")).alias("idempotency_key"),
    )


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None, single_file: bool = False) -> None:
    """Write CSV parts with a header and RFC 4180 quoting.

    With `order` the parts are range-sorted, so reading them in name order gives the
    whole result in order. `single_file` is for small, limited results.
    """
    if order:
        rows = rows.orderBy(*order)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_bucket_csv(buckets, path, meter, size, aggregation, unit, group_by=None, single_file=False) -> None:
    rows = bucket_csv(buckets, meter, size, aggregation, unit, group_by)
    names = [f for f in group_fields(group_by) if f != "subject"]
    order = ["bucket_start", "subject", *[F.col(f"`{n}`") for n in names]]
    write_csv(rows, path, order, single_file)


def write_event_csv(events: DataFrame, path: str, single_file: bool = False) -> None:
    ordered = events.orderBy(F.desc("event_time"), F.desc("id"))
    write_csv(event_csv(ordered), path, None, single_file)
