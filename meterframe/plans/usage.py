"""Registered usage queries: buckets, filters, aggregates, statistics, pages, series."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from meterframe.functions.predicates import Condition, all_of, any_of, subject_search
from meterframe.operators import paging, series, stats
from meterframe.operators.breakdown import aggregate_range, breakdown, dimension_values, share_of_max
from meterframe.operators.buckets import buckets
from meterframe.operators.scan import scan
from meterframe.plans.registry import EV, ITM, MET, ORD, ctes, query, rounded
from meterframe.plans.spec import QuerySpec, run_together
from meterframe.schema import AGGREGATIONS
from meterframe.sources.sinks import bucket_csv, event_csv
from meterframe.sources.tables import (
    event_meters,
    meters_from_usage,
    usage_from_events,
    usage_from_lineitem,
    usage_from_orders,
)

START, END = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"
LONG_START, LONG_END = "1990-01-01T00:00:00Z", "2010-01-01T00:00:00Z"

# Whole-bucket forms of the aggregations in SQL; `{seconds}` is the window length.
SQL_AGGREGATION = {
    "sum": "sum(quantity)",
    "count": "CAST(count(*) AS DOUBLE)",
    "avg": "avg(quantity)",
    "min": "min(quantity)",
    "max": "max(quantity)",
    "first": "first(quantity ORDER BY event_time, id)",
    "last": "first(quantity ORDER BY event_time DESC, id DESC)",
    "rate": "CAST(count(*) AS DOUBLE) / {seconds}",
}
SQL_SECONDS = {
    "hour": "3600.0",
    "day": "86400.0",
    "month": "date_diff('second', date_trunc('month', event_time), date_trunc('month', event_time) + INTERVAL 1 MONTH)",
}


def _register_buckets() -> None:
    """Every aggregation at every bucket size: events by hour and day, orders by month."""
    for size in ("hour", "day", "month"):
        for aggregation in AGGREGATIONS:
            measure = SQL_AGGREGATION[aggregation].format(seconds=f"any_value({SQL_SECONDS[size]})")
            if size == "month":
                source, cte, meter, where = usage_from_orders, ORD, "orders", "true"
                start, end = LONG_START, LONG_END
            else:
                source, cte, meter, where = usage_from_events, EV, "purchase", "meter_name = 'purchase'"
                start, end = START, END
            view = "ord" if size == "month" else "ev"
            digits = 6 if aggregation in ("sum", "avg") else 9
            sql = (
                ctes(cte)
                + f"""SELECT CAST(date_trunc('{size}', event_time) AS TIMESTAMP) AS bucket_start, '' AS subject,
       round({measure}, {digits}) AS quantity
FROM {view} WHERE {where} GROUP BY date_trunc('{size}', event_time)"""
            )

            def plan(
                spark,
                folder,
                size=size,
                aggregation=aggregation,
                source=source,
                meter=meter,
                span=(start, end),
                digits=digits,
            ):
                rows = buckets(source(spark, folder), meter, *span, size, aggregation)
                return rounded(rows, "quantity", digits=digits)

            query(f"bucket_{size}_{aggregation}", sql)(plan)


_register_buckets()


@query(
    "bucket_subject_day_sum",
    ctes(EV)
    + """SELECT date_trunc('day', event_time)::TIMESTAMP AS bucket_start, subject, round(sum(quantity), 6) AS quantity
FROM ev WHERE meter_name = 'purchase' GROUP BY 1, 2""",
)
def bucket_subject_day_sum(spark, folder):
    rows = buckets(usage_from_events(spark, folder), "purchase", START, END, "day", "sum", group_by="subject")
    return rounded(rows, "quantity")


@query(
    "bucket_grouped",
    ctes(EV)
    + """SELECT date_trunc('day', event_time)::TIMESTAMP AS bucket_start, subject,
  json_extract_string(metadata, '$.k') AS k, round(sum(quantity), 6) AS quantity
FROM ev WHERE meter_name = 'purchase' GROUP BY 1, 2, 3""",
)
def bucket_grouped(spark, folder):
    rows = buckets(
        usage_from_events(spark, folder),
        "purchase",
        START,
        END,
        "day",
        "sum",
        group_by="subject, metadata.k, k",
    )
    return rounded(rows, "quantity")


@query(
    "bucket_nil_group",
    ctes(EV)
    + """SELECT date_trunc('day', event_time)::TIMESTAMP AS bucket_start, '' AS subject,
  coalesce(json_extract_string(metadata, '$.k'), '<nil>') AS k,
  coalesce(json_extract_string(metadata, '$.region'), '<nil>') AS region, max(quantity) AS quantity
FROM ev WHERE meter_name = 'view' GROUP BY 1, 3, 4""",
)
def bucket_nil_group(spark, folder):
    return buckets(usage_from_events(spark, folder), "view", START, END, "day", "max", group_by=["k", "region"])


@query(
    "bucket_grouped_nested",
    ctes(ITM)
    + """SELECT date_trunc('month', event_time)::TIMESTAMP AS bucket_start, '' AS subject, flag, line AS terms_line,
  CAST(count(*) AS DOUBLE) AS quantity FROM itm GROUP BY 1, 3, 4""",
)
def bucket_grouped_nested(spark, folder):
    usage = usage_from_lineitem(spark, folder)
    return buckets(usage, "items", LONG_START, LONG_END, "month", "count", group_by=["flag", "terms.line"])


@query(
    "bucket_grouped_first_last",
    ctes(ORD)
    + """SELECT date_trunc('month', event_time)::TIMESTAMP AS bucket_start, '' AS subject, priority,
  first(quantity ORDER BY event_time DESC, id DESC) AS quantity FROM ord GROUP BY 1, 3""",
)
def bucket_grouped_first_last(spark, folder):
    usage = usage_from_orders(spark, folder)
    return buckets(usage, "orders", LONG_START, LONG_END, "month", "last", group_by="priority")


@query(
    "bucket_subject_limit",
    ctes(EV)
    + """SELECT date_trunc('hour', event_time)::TIMESTAMP AS bucket_start, subject, round(sum(quantity), 6) AS quantity
FROM ev WHERE meter_name = 'view' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""",
)
def bucket_subject_limit(spark, folder):
    rows = buckets(
        usage_from_events(spark, folder), "view", START, END, "hour", "sum", group_by="subject", limit=100
    )
    return rounded(rows, "quantity")


# --- filters ------------------------------------------------------------------------

FILTERS = {
    "eq_number": (Condition("metadata.k", "eq", 42), "k = 42"),
    "eq_wrong_type": (Condition("metadata.k", "eq", "42"), "false"),
    "neq": (Condition("metadata.k", "neq", 42), "k <> 42"),
    "neq_missing": (Condition("metadata.region", "neq", "eu"), "false"),
    "gt": (Condition("quantity", "gt", 50), "quantity > 50"),
    "gte": (Condition("metadata.k", "gte", 90), "k >= 90"),
    "gte_text": (Condition("metadata.k", "gte", "5"), "CAST(k AS VARCHAR) >= '5'"),
    "lt": (Condition("timestamp", "lt", "2024-01-10T12:30:00.5Z"), "event_time < TIMESTAMP '2024-01-10 12:30:00.5'"),
    "lte": (Condition("received_at", "lte", "2024-01-20T00:00:00+01:00"), "received_at <= TIMESTAMP '2024-01-19 23:00:00'"),
    "in": (Condition("metadata.k", "in", [1, 7, "9", 77]), "k IN (1, 7, 77)"),
    "in_subject": (Condition("subject", "in", ["user_1", "user_2"]), "subject IN ('user_1', 'user_2')"),
    "contains": (Condition("metadata.k", "contains", "7"), "contains(CAST(k AS VARCHAR), '7')"),
    "contains_literal": (Condition("idempotency_key", "contains", "%"), "contains(idempotency_key, '%')"),
    "exists": (Condition("metadata.k", "exists"), "k IS NOT NULL"),
    "exists_key": (Condition("idempotency_key", "exists"), "idempotency_key <> ''"),
    "or_nested": (
        any_of(
            all_of(Condition("metadata.k", "lt", 10), Condition("quantity", "gte", 20)),
            all_of(Condition("meter", "eq", "error"), Condition("subject", "neq", "user_3")),
        ),
        "((k < 10 AND quantity >= 20) OR (meter_name = 'error' AND subject <> 'user_3'))",
    ),
}


def _register_filters() -> None:
    for name, (tree, where) in FILTERS.items():
        sql = (
            ctes(EV, "evk AS (SELECT *, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM ev)")
            + f"""SELECT meter_name, count(*) AS usage_events, round(coalesce(sum(quantity), 0), 6) AS quantity
FROM evk WHERE {where} GROUP BY meter_name"""
        )

        def plan(spark, folder, tree=tree):
            rows = scan(usage_from_events(spark, folder), filter=tree)
            totals = rows.groupBy("meter_name").agg(
                F.count(F.lit(1)).alias("usage_events"), F.sum("quantity").alias("quantity")
            )
            return rounded(totals, "quantity")

        query(f"filter_{name}", sql)(plan)


_register_filters()


@query(
    "filter_bucket_nested_path",
    ctes(ITM)
    + """SELECT date_trunc('month', event_time)::TIMESTAMP AS bucket_start, '' AS subject, flag,
  round(sum(quantity), 6) AS quantity
FROM itm WHERE line = 'O' AND (discount >= 0.05 OR flag IN ('R', 'N')) AND flag <> 'R' GROUP BY 1, 3""",
)
def filter_bucket_nested_path(spark, folder):
    tree = all_of(
        Condition("metadata.terms.line", "eq", "O"),
        any_of(Condition("metadata.terms.discount", "gte", 0.05), Condition("metadata.flag", "in", ["R", "N"])),
        Condition("metadata.flag", "neq", "R"),
    )
    usage = usage_from_lineitem(spark, folder)
    rows = buckets(usage, "items", LONG_START, LONG_END, "month", "sum", group_by="flag", filter=tree)
    return rounded(rows, "quantity")


@query(
    "filter_metadata_map",
    ctes(EV)
    + """SELECT date_trunc('day', event_time)::TIMESTAMP AS bucket_start, '' AS subject, round(avg(quantity), 6) AS quantity
FROM ev WHERE meter_name = 'click' AND json_extract_string(metadata, '$.k') = '42' GROUP BY 1""",
)
def filter_metadata_map(spark, folder):
    rows = buckets(usage_from_events(spark, folder), "click", START, END, "day", "avg", metadata={"k": "42"})
    return rounded(rows, "quantity")


@query(
    "filter_allowed_meters",
    ctes(EV)
    + """SELECT meter_name, count(*) AS usage_events FROM ev
WHERE workspace_id = 'ws_2' AND meter_name IN ('view', 'click') GROUP BY 1""",
)
def filter_allowed_meters(spark, folder):
    rows = scan(usage_from_events(spark, folder), workspace="ws_2", allowed_meters=("view", "click"))
    return rows.groupBy("meter_name").agg(F.count(F.lit(1)).alias("usage_events"))


@query(
    "subject_search",
    ctes(EV)
    + "SELECT subject, count(*) AS usage_events FROM ev WHERE contains(lower(subject), 'r_1') GROUP BY 1",
)
def search(spark, folder):
    rows = usage_from_events(spark, folder).filter(subject_search(" R_1"))
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("usage_events"))


# --- scalar aggregates and breakdowns --------------------------------------------------


def _register_ranges() -> None:
    for aggregation in AGGREGATIONS:
        measure = SQL_AGGREGATION[aggregation].format(seconds="1296000.0")
        digits = 6 if aggregation in ("sum", "avg") else 9
        where = "event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-20'"

        def total(spark, folder, aggregation=aggregation, digits=digits):
            usage = usage_from_events(spark, folder)
            rows = aggregate_range(usage, "view", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", aggregation)
            return rounded(rows, "quantity", digits=digits)

        query(
            f"aggregate_{aggregation}",
            ctes(EV)
            + f"""SELECT round(coalesce({measure}, 0.0), {digits}) AS quantity, count(*) AS usage_events
FROM ev WHERE meter_name = 'view' AND {where}""",
        )(total)

        def by_subject(spark, folder, aggregation=aggregation, digits=digits):
            usage = usage_from_events(spark, folder)
            rows = breakdown(usage, "purchase", "subject", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", aggregation)
            return rounded(rows, "quantity", digits=digits)

        query(
            f"breakdown_subject_{aggregation}",
            ctes(EV)
            + f"""SELECT subject AS value, round({measure}, {digits}) AS quantity, count(*) AS usage_events
FROM ev WHERE meter_name = 'purchase' AND {where} GROUP BY subject""",
        )(by_subject)


_register_ranges()


@query(
    "aggregate_empty",
    "SELECT CAST(0 AS DOUBLE) AS quantity, CAST(count(*) AS BIGINT) AS usage_events FROM events WHERE event_type = 'refund'",
)
def aggregate_empty(spark, folder):
    return aggregate_range(usage_from_events(spark, folder), "refund", START, END, "sum")


@query(
    "breakdown_dimension_topk",
    ctes(EV)
    + """SELECT json_extract_string(metadata, '$.k') AS value, round(sum(quantity), 6) AS quantity, count(*) AS usage_events
FROM ev WHERE meter_name = 'purchase' GROUP BY 1 ORDER BY sum(quantity) DESC, 1 LIMIT 20""",
)
def breakdown_dimension_topk(spark, folder):
    rows = breakdown(usage_from_events(spark, folder), "purchase", "metadata.k", START, END, "sum", limit=20)
    return rounded(rows, "quantity")


@query(
    "breakdown_nested_dimension",
    ctes(ITM)
    + """SELECT line AS value, round(avg(quantity), 6) AS quantity, count(*) AS usage_events
FROM itm WHERE flag = 'A' GROUP BY 1""",
)
def breakdown_nested_dimension(spark, folder):
    usage = usage_from_lineitem(spark, folder)
    tree = Condition("metadata.flag", "eq", "A")
    return rounded(breakdown(usage, "items", "terms.line", LONG_START, LONG_END, "avg", filter=tree), "quantity")


@query(
    "breakdown_share",
    ctes(EV, "b AS (SELECT subject AS value, count(*) AS n FROM ev WHERE meter_name = 'view' GROUP BY 1)")
    + """SELECT value, CAST(n AS DOUBLE) AS quantity, n AS usage_events,
  round(greatest(4.0, CAST(n AS DOUBLE) / (SELECT max(n) FROM b) * 100), 6) AS share FROM b""",
)
def breakdown_share(spark, folder):
    rows = breakdown(usage_from_events(spark, folder), "view", "subject", START, END, "count")
    return rounded(share_of_max(rows), "share")


@query(
    "dimension_values",
    ctes(EV)
    + """SELECT json_extract_string(metadata, '$.k') AS value, count(*) AS usage_events
FROM ev WHERE meter_name = 'signup' GROUP BY 1""",
)
def dimension_value_counts(spark, folder):
    return dimension_values(usage_from_events(spark, folder), "signup", "k")


@query(
    "dimension_values_topk",
    ctes(ITM)
    + """SELECT CAST(discount AS VARCHAR) AS value, count(*) AS usage_events
FROM itm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def dimension_values_topk(spark, folder):
    return dimension_values(usage_from_lineitem(spark, folder), "items", "terms.discount", limit=5)


# --- statistics -----------------------------------------------------------------------


@query(
    "meter_stats",
    ctes(EV, MET)
    + """SELECT m.workspace_id, m.name AS meter_name, m.event_retention_days, count(e.id) AS usage_events,
  max(e.event_time) AS last_event_at
FROM met m LEFT JOIN ev e
  ON e.workspace_id = m.workspace_id AND e.meter_name = m.name GROUP BY 1, 2, 3""",
)
def meter_stats(spark, folder):
    return stats.meter_stats(usage_from_events(spark, folder), event_meters(spark, folder))


@query(
    "subject_stats",
    ctes(EV)
    + """SELECT workspace_id, subject, count(*) AS usage_events, count(DISTINCT meter_name) AS meters,
  max(event_time) AS last_event_at FROM ev GROUP BY 1, 2""",
)
def subject_stats(spark, folder):
    return stats.subject_stats(usage_from_events(spark, folder))


@query(
    "workspace_stats",
    ctes(EV, MET)
    + """SELECT workspace_id, count(*) AS usage_events,
  (SELECT count(*) FROM met m WHERE m.workspace_id = ev.workspace_id) AS meters,
  CAST(0 AS BIGINT) AS prune_runs, CAST(NULL AS TIMESTAMP) AS last_prune_at FROM ev GROUP BY 1""",
)
def workspace_stats(spark, folder):
    usage = usage_from_events(spark, folder)
    return stats.workspace_stats(usage, event_meters(spark, folder))


# --- pages ------------------------------------------------------------------------------

_PAGE = "SELECT id, subject, meter_name, quantity, event_time FROM ev"


@query("event_page_first", ctes(EV) + _PAGE + " ORDER BY event_time DESC, id DESC LIMIT 51")
def event_page_first(spark, folder):
    return paging.event_page(usage_from_events(spark, folder), 50).select("id", "subject", "meter_name", "quantity", "event_time")


@query(
    "event_page_next",
    ctes(EV)
    + _PAGE
    + """ WHERE (event_time < TIMESTAMP '2024-01-15 00:00:00'
  OR (event_time = TIMESTAMP '2024-01-15 00:00:00' AND id < '500')) ORDER BY event_time DESC, id DESC LIMIT 51""",
)
def event_page_next(spark, folder):
    got = paging.event_page(usage_from_events(spark, folder), 50, (datetime(2024, 1, 15), "500"))
    return got.select("id", "subject", "meter_name", "quantity", "event_time")


@query(
    "event_page_ties",
    ctes(ORD)
    + """SELECT id, subject, quantity, event_time FROM ord
WHERE event_time < TIMESTAMP '1998-06-01' OR (event_time = TIMESTAMP '1998-06-01' AND id < '7')
ORDER BY event_time DESC, id DESC LIMIT 101""",
)
def event_page_ties(spark, folder):
    got = paging.event_page(usage_from_orders(spark, folder), 100, (datetime(1998, 6, 1), "7"))
    return got.select("id", "subject", "quantity", "event_time")


_SUBJECTS = "s AS (SELECT workspace_id, subject, count(*) AS usage_events, count(DISTINCT meter_name) AS meters, max(event_time) AS last_event_at FROM ev GROUP BY 1, 2)"


@query("subject_page_first", ctes(EV, _SUBJECTS) + "SELECT * FROM s ORDER BY last_event_at DESC, subject LIMIT 11")
def subject_page_first(spark, folder):
    return paging.subject_page(stats.subject_stats(usage_from_events(spark, folder)), 10)


@query(
    "subject_page_next",
    ctes(EV, _SUBJECTS)
    + """SELECT * FROM s WHERE last_event_at < TIMESTAMP '2024-01-30 12:00:00'
  OR (last_event_at = TIMESTAMP '2024-01-30 12:00:00' AND subject > 'user_5')
ORDER BY last_event_at DESC, subject LIMIT 11""",
)
def subject_page_next(spark, folder):
    rows = stats.subject_stats(usage_from_events(spark, folder))
    return paging.subject_page(rows, 10, (datetime(2024, 1, 30, 12), "user_5"))


@query(
    "meter_page",
    ctes(EV, MET) + "SELECT name FROM met GROUP BY name HAVING name > 'click' ORDER BY name LIMIT 4",
)
def meter_page(spark, folder):
    names = event_meters(spark, folder).select("name").distinct()
    return paging.meter_page(names, 3, ("click",))


@query(
    "subject_events",
    ctes(EV)
    + "SELECT id, meter_name, quantity, event_time FROM ev WHERE subject = 'user_7' ORDER BY event_time DESC, id DESC LIMIT 25",
)
def subject_events(spark, folder):
    rows = paging.subject_events(usage_from_events(spark, folder), "user_7", 25)
    return rows.select("id", "meter_name", "quantity", "event_time")


# --- series -------------------------------------------------------------------------------


def _daily_by_k(spark, folder):
    return buckets(usage_from_events(spark, folder), "error", START, END, "day", "count", group_by=["k"])


_K_SERIES = """b AS (SELECT 'K: ' || json_extract_string(metadata, '$.k') AS series,
  date_trunc('day', event_time)::TIMESTAMP AS bucket_start, CAST(count(*) AS DOUBLE) AS quantity
  FROM ev WHERE meter_name = 'error' GROUP BY 1, 2),
grid AS (SELECT s.series, d.bucket_start, coalesce(b.quantity, 0.0) AS quantity
  FROM (SELECT DISTINCT series FROM b) s CROSS JOIN (SELECT DISTINCT bucket_start FROM b) d
  LEFT JOIN b ON b.series = s.series AND b.bucket_start = d.bucket_start)"""


@query("series_label", ctes(EV, _K_SERIES) + "SELECT series, bucket_start, quantity FROM b")
def series_label(spark, folder):
    return series.with_series(_daily_by_k(spark, folder), ["k"])


@query("series_gapfill", ctes(EV, _K_SERIES) + "SELECT series, bucket_start, quantity FROM grid")
def series_gapfill(spark, folder):
    return series.gap_fill(series.with_series(_daily_by_k(spark, folder), ["k"]))


@query(
    "series_cumulative",
    ctes(EV, _K_SERIES)
    + """SELECT series, bucket_start, sum(quantity) OVER (PARTITION BY series ORDER BY bucket_start) AS quantity FROM grid""",
)
def series_cumulative(spark, folder):
    return series.cumulative(series.gap_fill(series.with_series(_daily_by_k(spark, folder), ["k"])))


@query(
    "series_total",
    ctes(ORD)
    + """SELECT 'Total' AS series, bucket_start,
  round(sum(q) OVER (ORDER BY bucket_start), 4) AS quantity
FROM (SELECT date_trunc('month', event_time)::TIMESTAMP AS bucket_start, sum(quantity) AS q FROM ord GROUP BY 1)""",
)
def series_total(spark, folder):
    monthly = buckets(usage_from_orders(spark, folder), "orders", LONG_START, LONG_END, "month", "sum")
    return rounded(series.cumulative(series.with_series(monthly)), "quantity", digits=4)


# --- CSV layouts ------------------------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "csv_buckets",
    ctes(EV)
    + f"""SELECT {_ISO.format("date_trunc('day', event_time)")} AS bucket_start, subject, 'click' AS meter,
  'day' AS bucket_size, 'count' AS aggregation, 'call' AS unit, CAST(count(*) AS VARCHAR) AS quantity,
  json_extract_string(metadata, '$.k') AS k
FROM ev WHERE meter_name = 'click' GROUP BY date_trunc('day', event_time), subject, k""",
)
def csv_buckets(spark, folder):
    rows = buckets(usage_from_events(spark, folder), "click", START, END, "day", "count", group_by=["subject", "k"])
    return bucket_csv(rows, "click", "day", "count", "call", ["subject", "k"])


@query(
    "csv_events",
    ctes(EV)
    + f"""SELECT {_ISO.format("event_time")} AS timestamp, {_ISO.format("received_at")} AS received_at, subject,
  meter_name AS meter,
  CASE WHEN quantity = floor(quantity) THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) ELSE CAST(quantity AS VARCHAR) END
    AS quantity,
  replace(metadata, ': ', ':') AS metadata, id, idempotency_key
FROM ev""",
)
def csv_events(spark, folder):
    return event_csv(usage_from_events(spark, folder))


# --- saved specs ------------------------------------------------------------------------------

_SPECS = {
    "daily_k": dict(meter="view", bucket_size="day", group_by=["k"], workspace="ws_0"),
    "rate": dict(meter="click", bucket_size="month", workspace="ws_1"),
    "loud": dict(
        meter="purchase",
        bucket_size="hour",
        workspace="ws_2",
        filter={"type": "condition", "field": "metadata.k", "op": "gte", "value": 50},
    ),
    "first_subjects": dict(meter="purchase", bucket_size="day", group_by=["subject"], limit=7, workspace="ws_2"),
    "one_user": dict(meter="error", bucket_size="day", subject="user_4", workspace="ws_1"),
}
_SPEC_METERS = {"view": "sum", "click": "rate", "purchase": "max", "error": "last"}


@query(
    "saved_specs_run",
    ctes(EV)
    + """SELECT 'daily_k' AS spec, date_trunc('day', event_time)::TIMESTAMP AS bucket_start, '' AS subject,
  json_extract_string(metadata, '$.k') AS groups, round(sum(quantity), 6) AS quantity
FROM ev WHERE workspace_id = 'ws_0' AND meter_name = 'view' GROUP BY 2, 4
UNION ALL SELECT 'rate', TIMESTAMP '2024-01-01', '', '', round(count(*) / (31 * 86400.0), 6)
FROM ev WHERE workspace_id = 'ws_1' AND meter_name = 'click'
UNION ALL SELECT 'loud', date_trunc('hour', event_time)::TIMESTAMP, '', '', round(max(quantity), 6)
FROM ev WHERE workspace_id = 'ws_2' AND meter_name = 'purchase' AND CAST(json_extract_string(metadata, '$.k') AS DOUBLE) >= 50
GROUP BY 2
UNION ALL (SELECT 'first_subjects', date_trunc('day', event_time)::TIMESTAMP AS b, subject, subject AS g, round(max(quantity), 6)
FROM ev WHERE workspace_id = 'ws_2' AND meter_name = 'purchase' GROUP BY 2, 3 ORDER BY b, g LIMIT 7)
UNION ALL SELECT 'one_user', date_trunc('day', event_time)::TIMESTAMP, 'user_4', '',
  round(first(quantity ORDER BY event_time DESC, id DESC), 6)
FROM ev WHERE workspace_id = 'ws_1' AND meter_name = 'error' AND subject = 'user_4' GROUP BY 2""",
)
def saved_specs_run(spark, folder):
    """Five saved queries of four aggregations from one scan of the events."""
    meters = meters_from_usage(usage_from_events(spark, folder))
    kinds = F.create_map(*[F.lit(part) for pair in _SPEC_METERS.items() for part in pair])
    meters = meters.withColumn("aggregation", F.coalesce(F.try_element_at(kinds, "name"), "aggregation"))
    specs = [
        (key, QuerySpec.from_json(json.dumps({"start": START, "end": END, **spec}))) for key, spec in _SPECS.items()
    ]
    rows = run_together(specs, usage_from_events(spark, folder), meters)
    return rounded(rows.withColumn("groups", F.concat_ws("|", "groups")), "quantity")
