"""Saved query specs: what to compute, kept as data, run as DataFrame plans."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from meterframe.functions.aggregates import aggregate
from meterframe.functions.metadata import field_value
from meterframe.functions.predicates import from_dict, to_column
from meterframe.functions.timecalc import bucket_seconds, bucket_start, utc_naive
from meterframe.operators.breakdown import aggregate_range, breakdown
from meterframe.operators.buckets import buckets, group_column, group_fields
from meterframe.operators.scan import in_range
from meterframe.schema import MISSING_GROUP


@dataclass(frozen=True)
class QuerySpec:
    """One saved usage query. `kind` is `buckets`, `breakdown` or `aggregate`."""

    workspace: str
    meter: str
    start: str
    end: str
    kind: str = "buckets"
    bucket_size: str = "day"
    subject: str | None = None
    group_by: tuple[str, ...] = field(default_factory=tuple)
    filter: dict[str, Any] | None = None
    limit: int | None = None

    @classmethod
    def from_json(cls, text: str) -> "QuerySpec":
        data = json.loads(text)
        data["group_by"] = tuple(group_fields(data.get("group_by")))
        return cls(**data)


def meter_definition(meters: DataFrame, workspace: str, name: str):
    """The meter's row; the meter, not the caller, decides the aggregation."""
    row = meters.filter((F.col("workspace_id") == workspace) & (F.col("name") == name)).first()
    if row is None:
        raise LookupError(f"meter {name!r} was not found")
    return row


def run_spec(spec: QuerySpec, events: DataFrame, meters: DataFrame) -> DataFrame:
    """The spec's result as a lazy DataFrame."""
    meter = meter_definition(meters, spec.workspace, spec.meter)
    common = dict(
        meter=spec.meter,
        start=spec.start,
        end=spec.end,
        aggregation=meter["aggregation"],
        workspace=spec.workspace,
        subject=spec.subject,
        filter=from_dict(spec.filter),
    )
    if spec.kind == "buckets":
        declared = [d["name"] for d in meter["dimensions"] or []]
        return buckets(
            events,
            size=spec.bucket_size,
            group_by=list(spec.group_by),
            declared_fields=declared,
            limit=spec.limit,
            **common,
        )
    if spec.kind == "breakdown":
        return breakdown(events, field=spec.group_by[0], limit=spec.limit, **common)
    if spec.kind == "aggregate":
        return aggregate_range(events, **common)
    raise ValueError(f"unsupported query kind {spec.kind!r}")


SHARED_ROWS = "spec string, bucket_start timestamp_ntz, subject string, groups array<string>, quantity double"


def definitions(specs: list[QuerySpec], meters: DataFrame) -> dict[tuple[str, str], Row]:
    """The meters that specs name, by workspace and name; at most one row per spec."""
    wanted = sorted({(s.workspace, s.meter) for s in specs})
    if not wanted:
        return {}
    named = F.struct(F.col("workspace_id"), F.col("name"))
    rows = meters.filter(named.isin(*[F.struct(F.lit(w), F.lit(n)) for w, n in wanted]))
    return {(r["workspace_id"], r["name"]): r for r in rows.collect()}


def check_shared(spec: QuerySpec, known: dict[tuple[str, str], Row]) -> None:
    """Raises what `run_spec` would raise for a bucket spec."""
    if spec.kind != "buckets":
        raise ValueError(f"unsupported query kind {spec.kind!r}")
    meter = known.get((spec.workspace, spec.meter))
    if meter is None:
        raise LookupError(f"meter {spec.meter!r} was not found")
    if utc_naive(spec.start) >= utc_naive(spec.end):
        raise ValueError("from must be before to")
    declared = {d["name"] for d in meter["dimensions"] or []}
    unknown = [f for f in spec.group_by if f != "subject" and f not in declared]
    if unknown:
        raise ValueError(f"unknown group by field {unknown[0]!r}")


def run_together(specs: list[tuple[str, QuerySpec]], events: DataFrame, meters: DataFrame) -> DataFrame:
    """The rows of many bucket specs from one scan of the events.

    Each event is tagged with the specs it meets, and one partial aggregation by
    (spec, bucket, group values) serves them all. `groups` holds the group values in the
    order of the spec's fields; a spec's limit keeps its earliest rows, as `buckets` does.
    """
    known = definitions([spec for _, spec in specs], meters)
    for _, spec in specs:
        check_shared(spec, known)
    if not specs:
        return events.sparkSession.createDataFrame([], SHARED_ROWS)

    columns, time = events.columns, F.col("event_time")
    hits, tests = [], []
    for number, (_, spec) in enumerate(specs):
        test = (F.col("workspace_id") == spec.workspace) & (F.col("meter_name") == spec.meter)
        if spec.subject:
            test = test & (F.col("subject") == spec.subject)
        tests.append(test & in_range(time, spec.start, spec.end))
        values = [_group_value(field, columns) for field in spec.group_by]
        hit = F.struct(
            F.lit(number).alias("number"),
            bucket_start(time, spec.bucket_size).alias("bucket_start"),
            F.array(*values).cast("array<string>").alias("groups"),
        )
        hits.append(F.when(tests[-1] & to_column(from_dict(spec.filter), columns), hit))
    # The plain tests of all specs bound what the scan reads.
    if "event_date" in columns:
        first, last = min(utc_naive(s.start) for _, s in specs), max(utc_naive(s.end) for _, s in specs)
        events = events.filter(F.col("event_date").between(F.lit(first.date()), F.lit(last.date())))
    met = events.filter(reduce(lambda a, b: a | b, tests))
    tagged = met.select("quantity", "event_time", "id", F.explode(F.array_compact(F.array(*hits))).alias("hit"))

    names = [known[(s.workspace, s.meter)]["aggregation"] for _, s in specs]
    used = sorted({"count" if name == "rate" else name for name in names})
    sums = tagged.groupBy("hit.number", "hit.bucket_start", "hit.groups").agg(*[aggregate(n).alias(n) for n in used])
    seconds = {size: bucket_seconds(F.col("bucket_start"), size) for size in {s.bucket_size for _, s in specs}}

    def per_spec(value) -> Column:
        entries = [value(spec, name) for (_, spec), name in zip(specs, names)]
        return reduce(
            lambda made, i: made.when(F.col("number") == i, entries[i]), range(len(specs)), F.when(F.lit(False), None)
        )

    def quantity(spec: QuerySpec, name: str) -> Column:
        return F.col("count") / seconds[spec.bucket_size] if name == "rate" else F.col(name)

    def subject(spec: QuerySpec, _: str) -> Column:
        place = spec.group_by.index("subject") if "subject" in spec.group_by else None
        return F.lit(spec.subject or "") if place is None else F.get("groups", F.lit(place))

    rows = sums.select(
        "number",
        per_spec(lambda spec, name: F.lit(spec.limit).cast("int")).alias("limit"),
        F.element_at(F.array(*[F.lit(key) for key, _ in specs]), F.col("number") + 1).alias("spec"),
        "bucket_start",
        per_spec(subject).alias("subject"),
        "groups",
        per_spec(quantity).cast("double").alias("quantity"),
    )
    result = [name for name in rows.columns if name not in ("number", "limit")]
    if all(spec.limit is None for _, spec in specs):
        return rows.select(*result)
    order = Window.partitionBy("number").orderBy("bucket_start", "groups")
    most = max(spec.limit or 0 for _, spec in specs)
    limited = rows.filter(F.col("limit").isNotNull()).withColumn("place", F.row_number().over(order))
    limited = limited.filter((F.col("place") <= most) & (F.col("place") <= F.col("limit")))
    return rows.filter(F.col("limit").isNull()).select(*result).unionByName(limited.select(*result))


def _group_value(field: str, columns: list[str]) -> Column:
    value = field_value(field, columns)
    return value if field == "subject" else F.coalesce(value, F.lit(MISSING_GROUP))


def named_groups(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """A spec's rows of `run_together` in the columns of `buckets`."""
    names = [group_column(field) for field in spec.group_by]
    values = [F.get("groups", F.lit(i)).alias(name) for i, name in enumerate(names) if name != "subject"]
    return rows.select("bucket_start", "subject", *values, "quantity")


def saved_order(saved: DataFrame) -> list:
    """Pinned first, then position, then newest."""
    return [F.desc("pinned"), F.asc("position"), F.desc("updated_at"), F.desc("id")]


def overview(saved: DataFrame, count: int = 6) -> list[tuple[str, QuerySpec]]:
    """The first pinned saved queries, as (id, spec)."""
    rows = saved.filter("pinned").orderBy(*saved_order(saved)).limit(count).collect()
    return [(row["id"], QuerySpec.from_json(row["spec"])) for row in rows]


def run_specs(specs: list[tuple[str, QuerySpec]], events: DataFrame, meters: DataFrame) -> dict[str, DataFrame]:
    return {key: run_spec(spec, events, meters) for key, spec in specs}
