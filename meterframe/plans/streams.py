"""Registered streaming queries: each drains the events as a stream and reads the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz, utc_naive
from meterframe.operators import entitlements as ent
from meterframe.plans import alerting
from meterframe.plans.ingestion import ONE_BATCH, RAW, faulty_raw
from meterframe.plans.quota import (
    ASG,
    BASE,
    BEFORE,
    CNT,
    NOW,
    SQL_NOW,
    WIN,
    _progress_sql,
    _state,
    assignments,
    limits,
)
from meterframe.plans.registry import EV, MET, ctes, query, rounded
from meterframe.session import materialize, scratch_path
from meterframe.sources.readers import stream_parquet
from meterframe.sources.store import EventStore
from meterframe.sources.tables import as_usage, event_meters, raw_from_usage, table
from meterframe.streaming.ingest import drop_repeats_within, start_ingest
from meterframe.streaming.windows import (
    read_bucket_partials,
    sliding,
    sliding_of_partials,
    start_bucket_partials,
    tumbling,
    tumbling_of_partials,
    with_open_windows,
)


def usage_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return as_usage(stream_parquet(spark, f"{folder}/events.parquet", schema))


def _drain(rows: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame to its end into the shared folder and read it back."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
    writer.option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def _partials(spark, folder, size: str, keys: list[str]) -> DataFrame:
    """Bucket partials of the whole event stream."""
    path = scratch_path(spark, f"stream-{size}-partials")
    start_bucket_partials(usage_stream(spark, folder), size, keys, path, f"{path}-checkpoint").awaitTermination()
    return read_bucket_partials(spark, path, keys)


@query(
    "stream_tumbling_hour",
    ctes(EV)
    + """SELECT date_trunc('hour', event_time)::TIMESTAMP AS bucket_start, meter_name, round(sum(quantity), 6) AS quantity,
  count(*) AS usage_events FROM ev GROUP BY 1, 2""",
)
def stream_tumbling_hour(spark, folder):
    """Hours that the watermark has closed from the standing query, the last day's from the partials."""
    keys = ["meter_name"]
    closed = _drain(tumbling(usage_stream(spark, folder), "hour", "1 day", keys), "stream-hour")
    every = tumbling_of_partials(_partials(spark, folder, "hour", keys), "hour", keys)
    return rounded(with_open_windows(closed, every, ["bucket_start", *keys]), "quantity")


@query(
    "stream_sliding",
    ctes(EV)
    + """SELECT date_trunc('hour', event_time)::TIMESTAMP + to_hours(CAST(i + 1 AS INTEGER)) AS tick_at, workspace_id, meter_name,
  CAST(count(*) AS DOUBLE) AS quantity, count(*) AS usage_events FROM ev, range(0, 6) t(i) GROUP BY 1, 2, 3""",
)
def stream_sliding(spark, folder):
    """Six-hour look-back windows at every hour, as an alert rule sees them."""
    keys = ["workspace_id", "meter_name"]
    standing = sliding(usage_stream(spark, folder), "6 hours", "1 hour", "1 day", keys, "count")
    every = sliding_of_partials(_partials(spark, folder, "hour", keys), "hour", 6, keys, "count")
    return with_open_windows(_drain(standing, "stream-slide"), every, ["tick_at", *keys])


@query(
    "stream_month_partials",
    ctes(EV)
    + """SELECT date_trunc('month', event_time)::TIMESTAMP AS bucket_start, subject, count(*) AS event_count,
  round(sum(quantity), 6) AS quantity_sum, min(quantity) AS quantity_min, max(quantity) AS quantity_max,
  first(quantity ORDER BY event_time, received_at, id) AS quantity_first,
  first(quantity ORDER BY event_time DESC, received_at DESC, id DESC) AS quantity_last FROM ev GROUP BY 1, 2""",
)
def stream_month_partials(spark, folder):
    rows = _partials(spark, folder, "month", ["subject"]).withColumns(
        {"quantity_first": F.col("first_event.quantity"), "quantity_last": F.col("last_event.quantity")}
    )
    return rounded(rows.drop("first_event", "last_event"), "quantity_sum")


@query(
    "stream_bounded_dedupe",
    ctes(EV) + "SELECT DISTINCT workspace_id, idempotency_key FROM ev",
)
def stream_bounded_dedupe(spark, folder):
    rows = drop_repeats_within(usage_stream(spark, folder), "40 days")
    return _drain(rows.select("workspace_id", "idempotency_key"), "stream-dedupe")


@query(
    "stream_bounded_dedupe_keyless",
    ctes(EV)
    + """SELECT workspace_id, idempotency_key, count(*) AS kept FROM (
  SELECT DISTINCT workspace_id, idempotency_key FROM ev WHERE CAST(id AS BIGINT) % 10 <> 0
  UNION ALL SELECT workspace_id, NULL FROM ev WHERE CAST(id AS BIGINT) % 10 = 0) GROUP BY 1, 2""",
)
def stream_bounded_dedupe_keyless(spark, folder):
    """Every tenth event has no key; none of those is a repeat."""
    keyed = F.when(F.col("id").cast("long") % 10 != 0, F.col("idempotency_key"))
    rows = drop_repeats_within(usage_stream(spark, folder).withColumn("idempotency_key", keyed), "40 days")
    kept = _drain(rows.select("workspace_id", "idempotency_key"), "stream-keyless")
    return kept.groupBy("workspace_id", "idempotency_key").agg(F.count("*").alias("kept"))


@query(
    "stream_ingest",
    ctes(EV, RAW, ONE_BATCH)
    + "SELECT id, workspace_id, idempotency_key, subject, meter_name, quantity, event_time FROM ranked WHERE rn = 1",
)
def stream_ingest(spark, folder):
    """The faulty stream through the store: validated, deduplicated, appended, read back."""
    path = scratch_path(spark, "stream-ingest")
    store = EventStore(spark, path)
    meters = event_meters(spark, folder).filter("name <> 'error'")
    raw = faulty_raw(usage_stream(spark, folder))
    start_ingest(store, raw, meters, f"{path}-checkpoint").awaitTermination()
    return store.events().select(
        "id", "workspace_id", "idempotency_key", "subject", "meter_name", "quantity", "event_time"
    )


@query(
    "stream_counters",
    ctes(EV, ASG, WIN, CNT.replace("FROM ev e", "FROM (SELECT * FROM ev_ok) e")).replace(
        "usr AS",
        """ev_ok AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key
  ORDER BY CAST(id AS BIGINT)) AS rn FROM ev WHERE quantity > 0) WHERE rn = 1),
usr AS""",
        1,
    )
    + """SELECT workspace_id, subject, meter_name, period, period_start, event_count, round(quantity_sum, 6) AS quantity_sum,
  quantity_max, last_quantity FROM cnt""",
)
def stream_counters(spark, folder):
    """Quota counters that a streaming ingest keeps next to the events."""
    path = scratch_path(spark, "stream-counters")
    store = EventStore(spark, path)
    raw = raw_from_usage(usage_stream(spark, folder))
    start_ingest(
        store, raw, event_meters(spark, folder), f"{path}-checkpoint", assignments=assignments(spark, folder)
    ).awaitTermination()
    rows = ent.flat_counters(store.counters()).select(
        "workspace_id",
        "subject",
        "meter_name",
        "period",
        "period_start",
        "event_count",
        "quantity_sum",
        "quantity_max",
        "last_quantity",
    )
    return rounded(rows, "quantity_sum")


def _ingest_in_two_parts(spark, folder, path: str, before: str, now: str, store, meters, **options) -> None:
    """Stream the raw events up to `before` and then up to `now` into a store: two micro-batches of one stream.

    A part is as many files as the table's tasks write, and arrives when the part before is
    drained, so that a micro-batch holds a whole part and is read by many tasks.
    """
    events = table(spark, folder, "events")
    for start, end in (("2023-01-01T00:00:00Z", before), (before, now)):
        part = events.filter((F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))
        part.write.mode("append").parquet(f"{path}-input")
        raw = raw_from_usage(as_usage(stream_parquet(spark, f"{path}-input", events.schema)))
        tick = utc_naive(end)
        start_ingest(store, raw, meters, f"{path}-checkpoint", clock=lambda tick=tick: tick, **options).awaitTermination()


_BATCH_ENDS = {1: "TIMESTAMP '2024-01-24 12:00:00'", 2: SQL_NOW}
# The first row of each key, as the store accepts it.
_ACCEPTED = """ev_ok AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key
  ORDER BY CAST(id AS BIGINT)) AS rn FROM ev WHERE quantity > 0) WHERE rn = 1)"""


@query(
    "stream_quota_states",
    ctes(
        *BASE,
        _ACCEPTED,
        *[f"ev{i} AS (SELECT * FROM ev_ok WHERE event_time < {end})" for i, end in _BATCH_ENDS.items()],
        *[
            CNT.replace("placed AS", f"placed{i} AS").replace("FROM ev e", f"FROM ev{i} e").replace("cnt AS", f"cnt{i} AS").replace(
                "FROM placed e", f"FROM placed{i} e"
            )
            for i in _BATCH_ENDS
        ],
        *[
            _progress_sql(f"seen{i}", "fst", end).replace("LEFT JOIN cnt c", f"LEFT JOIN cnt{i} c")
            for i, end in _BATCH_ENDS.items()
        ],
        "keys1 AS (SELECT DISTINCT workspace_id, subject, meter_name FROM ev1)",
        f"""keys2 AS (SELECT DISTINCT workspace_id, subject, meter_name FROM ev2
  WHERE event_time >= {_BATCH_ENDS[1]})""",
        "new AS (SELECT s.* FROM seen2 s SEMI JOIN keys2 USING (workspace_id, subject, meter_name))",
        """old AS (SELECT s.* FROM seen1 s SEMI JOIN keys1 USING (workspace_id, subject, meter_name)
  ANTI JOIN new USING (workspace_id, subject, meter_name, plan_id, period))""",
        f"both_states AS (SELECT *, {SQL_NOW} AS at_time FROM new UNION ALL SELECT *, {_BATCH_ENDS[1]} FROM old)",
    )
    + f"""SELECT workspace_id, subject, meter_name, plan_id, period, {_state("current", "limit_value", "warning_percent")} AS state,
  round(current, 6) AS current, limit_value, at_time AS evaluated_at FROM both_states""",
)
def stream_quota_states(spark, folder):
    """Two micro-batches, each evaluated when it is committed: a key that the second one leaves alone keeps its state."""
    path = scratch_path(spark, "stream-quota")
    store, meters = EventStore(spark, path), event_meters(spark, folder)
    history, rules = assignments(spark, folder), limits(spark)

    def evaluate(batch_id, now):
        store.evaluate_quotas(batch_id, history, rules, meters, now)

    _ingest_in_two_parts(spark, folder, path, BEFORE, NOW, store, meters, assignments=history, after_batch=evaluate)
    rows = store.quota_states().select(*ent.STATE_KEY, "state", "current", "limit_value", "evaluated_at")
    return rounded(rows, "current")


@query(
    "stream_alert_states",
    ctes(
        EV,
        MET,
        _ACCEPTED,
        alerting._KINDS,
        alerting._RULES,
        alerting._EVK.replace("FROM ev)", "FROM ev_ok)"),
        alerting._values_sql("v1", alerting.SQL_BEFORE),
        alerting._states_sql("st1", "v1", None),
        alerting._values_sql("v2", alerting.SQL_NOW),
        alerting._states_sql("st", "v2", "st1"),
        f"""now_states AS (SELECT *, {alerting.SQL_NOW} AS evaluated_at FROM st
  UNION ALL SELECT *, {alerting.SQL_BEFORE} FROM st1 ANTI JOIN st USING (rule_id, group_key, group_value))""",
    )
    + """SELECT workspace_id, rule_id, group_key, group_value, status, round(value, 6) AS value, evaluated_at FROM now_states
WHERE rule_id IN (SELECT rule_id FROM rul WHERE enabled)""",
)
def stream_alert_states(spark, folder):
    """Two micro-batches; each evaluates the rules that it touches or that are due, against the kept states."""
    path = scratch_path(spark, "stream-alerts")
    store, meters = EventStore(spark, path), event_meters(spark, folder)
    rules = materialize(alerting.rules(meters), "rules")

    def evaluate(batch_id, now):
        store.evaluate_alerts(batch_id, rules, meters, now)

    _ingest_in_two_parts(spark, folder, path, alerting.BEFORE, alerting.NOW, store, meters, after_batch=evaluate)
    rows = store.alert_states().select("workspace_id", "rule_id", "group_key", "group_value", "status", "value", "evaluated_at")
    return rounded(rows, "value")
