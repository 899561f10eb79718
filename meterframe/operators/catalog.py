"""Meter definitions: validation, defaults, evolution, upserts and delete guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.schema import (
    AGGREGATIONS,
    DIMENSION_NAME_PATTERN,
    DIMENSION_TYPES,
    RETENTION_DEFAULT_DAYS,
    RETENTION_MAX_DAYS,
)


def humanized(name: Column) -> Column:
    """`service.tier` as `Service Tier`: only the first letter of a part changes."""
    parts = F.filter(F.split(name, r"[._-]"), lambda part: part != "")
    titled = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.array_join(titled, " ")


def normalize_meters(meters: DataFrame) -> DataFrame:
    """Trimmed text and defaults: aggregation sum, retention 90 days, display names."""

    def dimension(d: Column) -> Column:
        name = F.trim(d["name"])
        display = F.nullif(F.trim(F.coalesce(d["display_name"], F.lit(""))), F.lit(""))
        return F.struct(
            name.alias("name"),
            F.coalesce(display, humanized(name)).alias("display_name"),
            F.trim(F.coalesce(d["description"], F.lit(""))).alias("description"),
            d["type"].alias("type"),
            F.coalesce(d["required"], F.lit(False)).alias("required"),
            F.coalesce(d["deprecated"], F.lit(False)).alias("deprecated"),
        )

    retention = F.coalesce("event_retention_days", F.lit(0))
    return meters.withColumns(
        {
            "name": F.trim("name"),
            "description": F.trim(F.coalesce("description", F.lit(""))),
            "unit": F.trim("unit"),
            "aggregation": F.coalesce(F.nullif(F.col("aggregation"), F.lit("")), F.lit("sum")),
            "dimensions": F.transform(F.coalesce("dimensions", F.array()), dimension),
            "event_retention_days": F.when(retention == 0, RETENTION_DEFAULT_DAYS).otherwise(retention),
        }
    )


def dimension_message(dimensions: Column) -> Column:
    """Message for the first bad dimension definition, else NULL."""

    def check(d: Column) -> Column:
        name = F.coalesce(d["name"], F.lit(""))
        quoted = F.concat(F.lit('dimension name "'), name, F.lit('"'))
        return (
            F.when(name == "", "dimension name is required")
            .when(
                ~name.rlike(DIMENSION_NAME_PATTERN),
                F.concat(quoted, F.lit(" must use letters, numbers, underscores, hyphens, or dots")),
            )
            .when(name == "subject", F.concat(quoted, F.lit(" is reserved")))
            .when(
                ~F.coalesce(d["type"].isin(*DIMENSION_TYPES), F.lit(False)),
                F.concat(F.lit('unsupported dimension type "'), F.coalesce(d["type"], F.lit("")), F.lit('"')),
            )
        )

    names = F.transform(dimensions, lambda d: d["name"])
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    first_bad = F.try_element_at(F.array_compact(F.transform(dimensions, check)), F.lit(1))
    return F.coalesce(first_bad, F.when(repeated, "dimension is already defined"))


def validate_meters(meters: DataFrame) -> DataFrame:
    """Bad definitions as `(workspace_id, id, name, message)`; the first break per meter."""
    clean = normalize_meters(meters)
    name, unit = F.coalesce("name", F.lit("")), F.coalesce("unit", F.lit(""))
    days = F.col("event_retention_days")
    message = (
        F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "meter id is required")
        .when(name == "", "meter name is required")
        .when(unit == "", "meter unit is required")
        .when(
            ~F.col("aggregation").isin(*AGGREGATIONS),
            F.concat(F.lit('unsupported aggregation "'), F.col("aggregation"), F.lit('"')),
        )
        .otherwise(
            F.coalesce(
                dimension_message(F.col("dimensions")),
                F.when(days < 0, "event retention days must be greater than zero").when(
                    days > RETENTION_MAX_DAYS, f"event retention days cannot exceed {RETENTION_MAX_DAYS}"
                ),
            )
        )
    )
    return clean.select("workspace_id", "id", "name", message.alias("message")).filter(F.col("message").isNotNull())


def check_evolution(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    """Forbidden dimension changes of meters that have usage.

    `used` holds (workspace_id, meter_name) pairs. Removing, retyping, making required
    and adding a required dimension are refused; a deprecated one is not required.
    """
    key = ["workspace_id", "meter_name", "dimension"]

    def exploded(meters: DataFrame, prefix: str) -> DataFrame:
        rows = meters.select(
            "workspace_id", F.col("name").alias("meter_name"), F.inline("dimensions")
        )
        required = F.col("required") & ~F.coalesce("deprecated", F.lit(False))
        return rows.select(
            "workspace_id",
            "meter_name",
            F.col(rows.columns[2]).alias("dimension"),
            F.col("type").alias(f"{prefix}_type"),
            required.alias(f"{prefix}_required"),
        )

    pairs = ["workspace_id", "meter_name"]
    both = exploded(old, "old").join(exploded(new, "new"), key, "full_outer")
    both = both.join(used.select(*pairs).distinct(), pairs, "left_semi")
    # Only meters whose definition is being updated are checked.
    both = both.join(new.select("workspace_id", F.col("name").alias("meter_name")).distinct(), pairs, "left_semi")
    message = (
        F.when(F.col("new_type").isNull(), "cannot be removed after usage has been recorded")
        .when(
            F.col("old_type").isNull(),
            F.when(F.col("new_required"), "cannot be added after usage has been recorded"),
        )
        .when(F.col("old_type") != F.col("new_type"), "type cannot change after usage has been recorded")
        .when(~F.col("old_required") & F.col("new_required"), "cannot become required after usage has been recorded")
    )
    return both.select(*key, message.alias("message")).filter(F.col("message").isNotNull())


def upsert(table: DataFrame, rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest row per key after adding `rows`; on equal versions the added row wins."""
    rest = [c for c in table.columns if c not in key]
    both = table.withColumn("added", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("added", F.lit(1)))
    newest = F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("added"))).alias("newest")
    return both.groupBy(*key).agg(newest).select(*key, "newest.*").select(*table.columns)


def delete_guard(candidates: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that something still refers to, so they must not be deleted."""
    return candidates.join(references.select(*key), key, "left_semi")
