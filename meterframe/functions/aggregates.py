"""The eight meter aggregations, and their mergeable partial form.

`first` and `last` order by event time and break ties by id. They are `min_by` /
`max_by` over a struct, so they aggregate partially on the map side and no group is
ever collected or sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.schema import AGGREGATIONS


def aggregate(
    name: str,
    seconds: Column | None = None,
    quantity: str = "quantity",
    event_time: str = "event_time",
    id_column: str = "id",
) -> Column:
    """One of the eight aggregations as a double; `rate` needs the window seconds."""
    value = F.col(quantity)
    order = F.struct(F.col(event_time), F.col(id_column))
    if name == "sum":
        return F.sum(value)
    if name == "count":
        return F.count(F.lit(1)).cast("double")
    if name == "avg":
        return F.avg(value)
    if name == "min":
        return F.min(value)
    if name == "max":
        return F.max(value)
    if name == "first":
        return F.min_by(value, order)
    if name == "last":
        return F.max_by(value, order)
    if name == "rate":
        if seconds is None:
            raise ValueError("rate needs the window length in seconds")
        return F.count(F.lit(1)).cast("double") / seconds
    raise ValueError(f"aggregation must be one of {AGGREGATIONS}: {name!r}")


# --- partials ------------------------------------------------------------------
#
# A partial can be merged with any other partial of the same key, in any order, so
# the same columns serve batch, incremental and streaming use.

PARTIAL_COLUMNS = [
    "event_count",
    "quantity_sum",
    "quantity_min",
    "quantity_max",
    "first_event",
    "last_event",
]


def event_point() -> Column:
    """Sort key plus quantity of one event: the order that first and last follow."""
    return F.struct(
        F.col("event_time").alias("event_time"),
        F.col("received_at").alias("received_at"),
        F.col("id").alias("id"),
        F.col("quantity").alias("quantity"),
    )


def partial_of_events(ordered: bool = True) -> list[Column]:
    """Partials from events. `ordered=False` leaves out first and last, which keeps
    the aggregate on fixed-width buffers (hash aggregation)."""
    columns = [
        F.count(F.lit(1)).alias("event_count"),
        F.sum("quantity").alias("quantity_sum"),
        F.min("quantity").alias("quantity_min"),
        F.max("quantity").alias("quantity_max"),
    ]
    if ordered:
        columns += [
            F.min(event_point()).alias("first_event"),
            F.max(event_point()).alias("last_event"),
        ]
    return columns


def merged(ordered: bool = True) -> dict[str, Column]:
    """How each partial column merges, for an aggregation or a window."""
    columns = {
        "event_count": F.sum("event_count"),
        "quantity_sum": F.sum("quantity_sum"),
        "quantity_min": F.min("quantity_min"),
        "quantity_max": F.max("quantity_max"),
    }
    if ordered:
        columns |= {"first_event": F.min("first_event"), "last_event": F.max("last_event")}
    return columns


def merge_partials(ordered: bool = True) -> list[Column]:
    """Partials from partials."""
    return [column.alias(name) for name, column in merged(ordered).items()]


def partial_value(
    aggregation: Column,
    seconds: Column,
    first_quantity: Column | None = None,
    last_quantity: Column | None = None,
) -> Column:
    """The meter's value from a partial; no events give 0."""
    count = F.col("event_count").cast("double")
    if first_quantity is None:
        first_quantity = F.col("first_event.quantity")
    if last_quantity is None:
        last_quantity = F.col("last_event.quantity")
    value = (
        F.when(aggregation == "count", count)
        .when(aggregation == "avg", F.col("quantity_sum") / count)
        .when(aggregation == "min", F.col("quantity_min"))
        .when(aggregation == "max", F.col("quantity_max"))
        .when(aggregation == "first", first_quantity)
        .when(aggregation == "last", last_quantity)
        .when(aggregation == "rate", F.when(seconds > 0, count / seconds).otherwise(0.0))
        .otherwise(F.col("quantity_sum"))
    )
    return F.when(F.coalesce(F.col("event_count"), F.lit(0)) > 0, value).otherwise(0.0)
