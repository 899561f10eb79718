"""Usage-event, meter, plan and rule views over the driver's tables.

Everything is derived from the tables with columns and joins, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workspace_of(number: Column) -> Column:
    return F.concat(F.lit("ws_"), F.pmod(number, F.lit(3)).cast("string"))


def usage_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as usage events: one meter per event type."""
    return as_usage(table(spark, folder, "events"))


def as_usage(events: DataFrame) -> DataFrame:
    """Event-stream rows (batch or streaming) as usage events."""
    hour = F.substring(F.col("ts").cast("string"), 1, 13)
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        workspace_of(F.col("user_id")).alias("workspace_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type", hour).alias("idempotency_key"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("meter_name"),
        F.col("value").alias("quantity"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("received_at"),
        F.col("props").alias("metadata"),
    )


def raw_from_usage(usage: DataFrame) -> DataFrame:
    """Usage events as raw ingest rows; the event id gives the input order."""
    return usage.select(
        F.col("id").cast("long").alias("index"),
        "id",
        "workspace_id",
        "idempotency_key",
        "subject",
        F.col("meter_name").alias("meter"),
        "quantity",
        F.col("event_time").alias("timestamp"),
        "metadata",
    )


def usage_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as usage of the meter `orders`, spread over several years."""
    orders = table(spark, folder, "orders")
    customer = F.col("o_custkey")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        workspace_of(customer).alias("workspace_id"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.concat(F.lit("c"), customer.cast("string")).alias("subject"),
        F.lit("orders").alias("meter_name"),
        F.col("o_totalprice").alias("quantity"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderdate").alias("received_at"),
        F.concat(
            F.lit('{"priority":"'), "o_orderpriority", F.lit('","status":"'), "o_orderstatus", F.lit('"}')
        ).alias("metadata"),
    )


def usage_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as usage of the meter `items`, one subject per supplier."""
    items = table(spark, folder, "lineitem")
    supplier = F.col("l_suppkey")
    return items.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        workspace_of(supplier).alias("workspace_id"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.concat(F.lit("s"), supplier.cast("string")).alias("subject"),
        F.lit("items").alias("meter_name"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_shipdate").alias("received_at"),
        F.concat(
            F.lit('{"flag":"'),
            "l_returnflag",
            F.lit('","terms":{"line":"'),
            "l_linestatus",
            F.lit('","discount":'),
            F.col("l_discount").cast("string"),
            F.lit("}}"),
        ).alias("metadata"),
    )


# Fixed choice of an aggregation per event type.
EVENT_AGGREGATION = {"click": "count", "view": "sum", "purchase": "sum", "signup": "max", "error": "last"}


def meters_from_usage(usage: DataFrame) -> DataFrame:
    """One meter definition per (workspace, meter) that occurs in the usage."""
    name = F.col("meter_name")
    aggregation = F.lit("sum")
    for meter, value in EVENT_AGGREGATION.items():
        aggregation = F.when(name == meter, value).otherwise(aggregation)
    dimension = F.struct(
        F.lit("k").alias("name"),
        F.lit("K").alias("display_name"),
        F.lit("").alias("description"),
        F.lit("number").alias("type"),
        F.lit(True).alias("required"),
        F.lit(False).alias("deprecated"),
    )
    pairs = usage.select("workspace_id", "meter_name").distinct()
    return pairs.select(
        F.concat_ws("/", "workspace_id", "meter_name").alias("id"),
        "workspace_id",
        name.alias("name"),
        F.lit("").alias("description"),
        F.lit("unit").alias("unit"),
        aggregation.alias("aggregation"),
        F.array(dimension).alias("dimensions"),
        (F.length("meter_name") * 2).alias("event_retention_days"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def event_meters(spark: SparkSession, folder: str) -> DataFrame:
    """The meters of the event table, written once as the catalog table they stand for."""
    return materialize(meters_from_usage(usage_from_events(spark, folder)), "meters")


__all__ = [
    "event_meters",
    "as_usage",
    "meters_from_usage",
    "raw_from_usage",
    "table",
    "usage_from_events",
    "usage_from_lineitem",
    "usage_from_orders",
    "workspace_of",
]
