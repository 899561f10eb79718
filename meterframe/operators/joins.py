"""Joins of the event table with a smaller side.

Joins between catalog, assignment and counter tables need none of this: they are plain
`join` calls, for which Spark picks and, at run time, revises the strategy.

Two physical shapes, chosen by a check of the smaller side's row count:

* it fits the bound: broadcast, so the large side is not shuffled;
* it does not: a shuffled join in which keys with a large share of the rows are salted. A key that
  holds a third of all rows then spreads over `SALTS` partitions, and the salt in the
  join keys also makes a following `groupBy` shuffle its partial results instead of
  finishing a hot group in the join's own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.session import materialize

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20
HOT_SHARE = 0.25  # of an even partition: a key with more of the rows is salted
SALTS = 256


def fits(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether `side` is small in rows and in bytes; reads no further than `max_rows`."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in side.columns])))
    size = side.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(text).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def hot_keys(facts: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than `share` of an even partition's rows, written once.

    Counting aggregates on the map side. At most partitions / share keys can be that heavy,
    so the result is bounded, and any key outside fits into a partition several times.
    """
    spark = facts.sparkSession
    counts = materialize(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    even = total / int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(counts.filter(F.col("n") > share * even).select(*keys), "hot-keys")


def dealt_out(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by `columns` to all shuffle partitions, which adaptive execution then leaves apart.

    For the input of a step that sorts several rows for each row it reads: merged into a few
    large partitions it would hold memory of a multiple of their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def spread_by_row() -> Column:
    """A salt source that differs from row to row and is stable across task retries."""
    return F.xxhash64("id")


def side_join(
    facts: DataFrame,
    side: DataFrame,
    keys: list[str],
    how: str = "inner",
    residual: Column | None = None,
    spread: Column | None = None,
    max_rows: int = BROADCAST_MAX_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Equi join on `keys` plus an optional residual condition.

    `side` must not share column names with `facts` other than `keys`. `spread` is a
    hash of a column that varies between the rows of one key (default: the event id).
    `small` passes on a size check the caller has already made.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    renamed = side
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__{key}")
    condition = _all([F.col(key) == F.col(f"__{key}") for key in keys])
    if residual is not None:
        condition = condition & residual
    drop = [f"__{key}" for key in keys]
    if fits(side, max_rows) if small is None else small:
        return facts.join(F.broadcast(renamed), condition, how).drop(*drop)

    hot = hot_keys(facts, keys).withColumn("__hot", F.lit(True))
    salt = F.pmod(F.xxhash64(spread if spread is not None else spread_by_row()), F.lit(SALTS)).cast("int")
    salted_facts = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0))
        .drop("__hot")
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot_side = hot.select(*[F.col(key).alias(f"__{key}") for key in keys], "__hot")
    salted_side = (
        renamed.join(F.broadcast(hot_side), drop, "left")
        .withColumn("__side_salt", F.explode(copies))
        .drop("__hot")
    )
    condition = condition & (F.col("__salt") == F.col("__side_salt"))
    return salted_facts.join(salted_side, condition, how).drop(*drop, "__salt", "__side_salt")


def _all(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result & test
    return result


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key as a mergeable aggregate (no window, no sort of a group)."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)


def with_latest_delivery(alert_events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Alert events with their newest delivery attempt, if any."""
    newest = latest_by(
        deliveries.select("event_id", "attempted_at", "delivery_id", "status"),
        ["event_id"],
        ["attempted_at", "delivery_id"],
    ).select(
        F.col("event_id").alias("id"),
        F.col("delivery_id"),
        F.col("status").alias("delivery_status"),
        F.col("attempted_at").alias("delivery_attempted_at"),
    )
    return alert_events.join(newest, "id", "left")
