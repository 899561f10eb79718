"""Registered alert queries: evaluation, transitions, backtest, history, outbox."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz
from meterframe.operators import alerts
from meterframe.operators.joins import with_latest_delivery
from meterframe.plans.registry import EV, MET, ctes, query, rounded
from meterframe.schema import ALERT_STATE
from meterframe.session import materialize, scratch_path
from meterframe.sources.store import EventStore
from meterframe.sources.tables import event_meters, raw_from_usage, table, usage_from_events

NOW = "2024-01-25T12:00:00Z"
BEFORE = "2024-01-25T06:00:00Z"
SQL_NOW = "TIMESTAMP '2024-01-25 12:00:00'"
SQL_BEFORE = "TIMESTAMP '2024-01-25 06:00:00'"

# Rules follow from the meters in use: one global rule, one per subject, one per `k`
# and one with a metadata condition for every (workspace, meter). Thresholds depend
# on the aggregation of the meter.
_THRESHOLD = {"count": 10.0, "max": 60.0, "last": 12.0, "sum": 100.0}


def rules(meters: DataFrame) -> DataFrame:
    no_metadata = F.create_map().cast("map<string,string>")
    threshold = F.create_map(*[F.lit(v) for pair in _THRESHOLD.items() for v in pair])[F.col("aggregation")]

    def kind(name, group_by, window, interval, comparator, factor, metadata=no_metadata, enabled=None):
        return meters.select(
            F.concat_ws("/", "workspace_id", F.col("name"), F.lit(name)).alias("rule_id"),
            "workspace_id",
            F.concat_ws(" ", F.lit("rule"), F.col("name")).alias("rule_name"),
            F.col("name").alias("meter_name"),
            (enabled if enabled is not None else F.lit(True)).alias("enabled"),
            F.lit("").alias("subject"),
            metadata.alias("metadata"),
            F.lit(window).cast("long").alias("window_seconds"),
            F.lit(comparator).alias("comparator"),
            (threshold * factor).alias("threshold"),
            F.lit(interval).cast("long").alias("evaluation_interval_seconds"),
            F.lit(group_by).alias("group_by"),
            ntz("2024-01-25T00:00:00Z").alias("next_evaluate_at"),
        )

    only_42 = F.create_map(F.lit("k"), F.lit("42"))
    rows = kind("global", "", 6 * 3600, 3600, "gte", 1.0)
    rows = rows.unionByName(kind("subject", "subject", 12 * 3600, 7200, "gt", 0.1))
    rows = rows.unionByName(kind("k", "metadata.k", 86400, 14400, "", 0.2))
    rows = rows.unionByName(kind("k42", "", 86400, 21600, "lt", 0.3, only_42))
    off = F.col("name") != "view"
    rows = rows.unionByName(kind("off", "subject", 3600, 60, "neq", 1.0, enabled=off))
    return rows.withColumnRenamed("rule_name", "name")


# Columns: kind, group key, window, interval, comparator, threshold factor.
_KINDS = """kinds(kind, group_key, window_seconds, step, comparator, factor) AS (VALUES
  ('global', '', 21600, 3600, 'gte', 1.0), ('subject', 'subject', 43200, 7200, 'gt', 0.1),
  ('k', 'k', 86400, 14400, 'gte', 0.2), ('k42', '', 86400, 21600, 'lt', 0.3), ('off', 'subject', 3600, 60, 'neq', 1.0))"""
_RULES = """rul AS (SELECT m.workspace_id || '/' || m.name || '/' || kind AS rule_id, m.workspace_id, m.name AS meter_name,
  m.aggregation, kind, group_key, window_seconds, step, comparator, NOT (kind = 'off' AND m.name = 'view') AS enabled,
  CAST(factor AS DOUBLE) * CASE m.aggregation WHEN 'count' THEN 10.0 WHEN 'max' THEN 60.0 WHEN 'last' THEN 12.0 ELSE 100.0 END AS threshold
  FROM met m, kinds)"""
_EVK = "evk AS (SELECT *, json_extract_string(metadata, '$.k') AS k FROM ev)"
_MEASURE = """CASE any_value(r.aggregation) WHEN 'count' THEN CAST(count(*) AS DOUBLE) WHEN 'max' THEN max(quantity)
    WHEN 'last' THEN first(quantity ORDER BY event_time DESC, received_at DESC, e.id DESC) ELSE sum(quantity) END"""
_HIT = """CASE comparator WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold
  WHEN 'neq' THEN value <> threshold ELSE value >= threshold END"""
_GROUP_VALUE = "CASE group_key WHEN '' THEN '' WHEN 'subject' THEN e.subject ELSE e.k END"


def _values_sql(name: str, at: str) -> str:
    return f"""{name} AS (SELECT r.workspace_id, rule_id, group_key, {_GROUP_VALUE} AS group_value, {_MEASURE} AS value, count(*) AS n
  FROM rul r JOIN evk e ON e.workspace_id = r.workspace_id AND e.meter_name = r.meter_name
   AND e.event_time >= {at} - to_seconds(window_seconds) AND e.event_time < {at} AND (kind <> 'k42' OR e.k = '42')
  WHERE enabled GROUP BY 1, 2, 3, 4)"""


def _states_sql(name: str, values: str, previous: str | None) -> str:
    """State rows from values, remembered groups and rules."""
    known = f"SELECT workspace_id, rule_id, group_key, group_value FROM {values}"
    if previous:
        known += f" UNION SELECT workspace_id, rule_id, group_key, group_value FROM {previous} WHERE group_key <> ''"
    known += " UNION SELECT workspace_id, rule_id, '', '' FROM rul WHERE enabled AND group_key = ''"
    before = f"LEFT JOIN {previous} p USING (rule_id, group_key, group_value)" if previous else ""
    # A grouped rule does not look at the empty group's earlier state.
    was = "CASE WHEN s.group_key = s.rule_group OR s.group_key <> '' THEN p.status END" if previous else "CAST(NULL AS VARCHAR)"
    return f"""{name}_known AS ({known}),
{name}_all AS (SELECT * FROM {name}_known UNION ALL SELECT workspace_id, rule_id, '', '' FROM rul
  WHERE enabled AND rule_id NOT IN (SELECT rule_id FROM {name}_known)),
{name}_val AS (SELECT a.workspace_id, a.rule_id, a.group_key, a.group_value, coalesce(v.value, 0.0) AS value,
  CAST(coalesce(v.n, 0) AS BIGINT) AS usage_events, r.comparator, r.threshold, r.rule_group
  FROM {name}_all a JOIN (SELECT rule_id, comparator, threshold, group_key AS rule_group FROM rul) r USING (rule_id) LEFT JOIN {values} v USING (rule_id, group_key, group_value)),
{name} AS (SELECT s.*, {was} AS previous_status FROM (
  SELECT *, CASE WHEN usage_events = 0 THEN 'no_data' WHEN {_HIT} THEN 'alerting' ELSE 'ok' END AS status FROM {name}_val) s {before}
  UNION ALL SELECT workspace_id, rule_id, '', '', 0.0, 0, comparator, threshold, group_key, 'ok', NULL FROM rul WHERE NOT enabled)"""


_ONE = ctes(EV, MET, _KINDS, _RULES, _EVK, _values_sql("v2", SQL_NOW), _states_sql("st", "v2", None))
_TWO = ctes(
    EV,
    MET,
    _KINDS,
    _RULES,
    _EVK,
    _values_sql("v1", SQL_BEFORE),
    _states_sql("st1", "v1", None),
    _values_sql("v2", SQL_NOW),
    _states_sql("st", "v2", "st1"),
    """typed AS (SELECT *, CASE WHEN status = 'alerting' AND previous_status IS DISTINCT FROM 'alerting' THEN 'triggered'
  WHEN status <> 'alerting' AND previous_status = 'alerting' THEN 'resolved' END AS event_type FROM st)""",
)


def _empty_states(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_STATE)


def _evaluate_once(spark, folder, at: str) -> DataFrame:
    usage, meters = usage_from_events(spark, folder), event_meters(spark, folder)
    all_rules = materialize(rules(meters), "rules")
    return alerts.evaluate(all_rules, usage, meters, _empty_states(spark), at)


def _evaluate_twice(spark, folder) -> DataFrame:
    usage, meters = usage_from_events(spark, folder), event_meters(spark, folder)
    all_rules = materialize(rules(meters), "rules")
    first = alerts.states(alerts.evaluate(all_rules, usage, meters, _empty_states(spark), BEFORE))
    return alerts.evaluate(all_rules, usage, meters, materialize(first, "alert-states"), NOW)


_STATE_COLUMNS = "workspace_id, rule_id, group_key, group_value, status, round(value, 6) AS value, usage_events"


@query("alert_global", _ONE + f"SELECT {_STATE_COLUMNS} FROM st WHERE group_key = ''")
def alert_global(spark, folder):
    rows = _evaluate_once(spark, folder, NOW).filter("group_key = ''")
    return rounded(rows.select(*alerts.GROUP, "status", "value", "usage_events"), "value")


@query("alert_grouped", _ONE + f"SELECT {_STATE_COLUMNS} FROM st WHERE group_key <> ''")
def alert_grouped(spark, folder):
    rows = _evaluate_once(spark, folder, NOW).filter("group_key <> ''")
    return rounded(rows.select(*alerts.GROUP, "status", "value", "usage_events"), "value")


@query(
    "alert_grouped_panes",
    ctes(
        EV,
        MET,
        _KINDS,
        _RULES,
        # The first batch holds the rows with an odd id, and the first row of a key stays.
        """ev_ok AS (SELECT * EXCLUDE (rn, received_at), CASE WHEN CAST(id AS BIGINT) % 2 = 1 THEN 1 ELSE 2 END AS received_at
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key
    ORDER BY CAST(id AS BIGINT) % 2 DESC, CAST(id AS BIGINT)) AS rn FROM ev WHERE quantity > 0) WHERE rn = 1)""",
        _EVK.replace("FROM ev)", "FROM ev_ok)"),
        _values_sql("v2", SQL_NOW),
        _states_sql("st", "v2", None),
    )
    + f"SELECT {_STATE_COLUMNS} FROM st",
)
def alert_grouped_panes(spark, folder):
    """Rules over a store's panes; its two batches overlap in time, so their panes merge."""
    store = EventStore(spark, scratch_path(spark, "alert-panes"), panes=("k",))
    meters = event_meters(spark, folder)
    raw = raw_from_usage(usage_from_events(spark, folder))
    for part, at in ((1, "2024-02-01T00:00:00Z"), (0, "2024-02-02T00:00:00Z")):
        store.ingest(raw.filter(F.col("index") % 2 == part), meters, f"part-{part}", at)
    all_rules = materialize(rules(meters), "rules")
    values = store.alert_values(all_rules, meters, NOW)
    states = alerts.evaluate(all_rules, store.events(), meters, _empty_states(spark), NOW, values)
    return rounded(states.select(*alerts.GROUP, "status", "value", "usage_events"), "value")


@query(
    "alert_states",
    _TWO + f"SELECT {_STATE_COLUMNS}, previous_status, event_type, {SQL_NOW} AS evaluated_at FROM typed",
)
def alert_states(spark, folder):
    return rounded(_evaluate_twice(spark, folder).drop("message"), "value")


@query(
    "alert_transitions",
    _TWO + "SELECT workspace_id, rule_id, group_key, group_value, event_type AS type, round(value, 6) AS value FROM typed WHERE event_type IS NOT NULL",
)
def alert_transitions(spark, folder):
    events = alerts.events_of(_evaluate_twice(spark, folder))
    return rounded(events.select(*alerts.GROUP, "type", "value"), "value")


@query(
    "alert_message",
    _ONE
    + """SELECT s.rule_id, s.group_key, s.group_value, CASE WHEN NOT r.enabled THEN 'alert rule is disabled' ELSE
  CASE s.status WHEN 'no_data' THEN 'no usage data in alert window'
    WHEN 'alerting' THEN printf('value %.4f %s threshold %.4f', s.value, s.comparator, s.threshold)
    ELSE printf('value %.4f is within threshold %.4f', s.value, s.threshold) END
  || CASE WHEN s.group_key = '' AND s.group_value = '' THEN '' ELSE ' for ' || s.group_key || ' ' || s.group_value END END AS message
FROM st s JOIN (SELECT rule_id, enabled FROM rul) r USING (rule_id)""",
)
def alert_message(spark, folder):
    return _evaluate_once(spark, folder, NOW).select("rule_id", "group_key", "group_value", "message")


_PRIORITY = "CASE status WHEN 'alerting' THEN 0 WHEN 'error' THEN 1 WHEN 'no_data' THEN 2 ELSE 3 END"


@query(
    "alert_primary_state",
    _ONE
    + f"""SELECT workspace_id, rule_id, group_key, group_value, status FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY {_PRIORITY}, group_key, group_value) AS rn FROM st) WHERE rn = 1""",
)
def alert_primary_state(spark, folder):
    states = alerts.states(_evaluate_once(spark, folder, NOW))
    return alerts.primary_state(states).select(*alerts.GROUP, "status")


@query(
    "alert_by_priority",
    _ONE
    + f"""SELECT rule_id, group_key, group_value, status FROM st
ORDER BY {_PRIORITY}, rule_id, group_key, group_value LIMIT 200""",
)
def alert_by_priority(spark, folder):
    states = alerts.states(_evaluate_once(spark, folder, NOW))
    return alerts.by_priority(states, 200).select("rule_id", "group_key", "group_value", "status")


@query(
    "alert_outbox",
    _TWO
    + """SELECT workspace_id, rule_id, event_type AS type, status, group_value, meter_name, round(value, 4) AS value,
  CAST(window_seconds AS BIGINT) AS window_seconds, '2024-01-25T12:00:00Z' AS created_at
FROM (SELECT t.*, r.meter_name, r.window_seconds FROM typed t JOIN rul r USING (rule_id) WHERE event_type IS NOT NULL)""",
)
def alert_outbox(spark, folder):
    """Notifications, with their JSON read back into columns."""
    evaluated = materialize(_evaluate_twice(spark, folder), "alert-evaluation")
    all_rules = alerts.normalize_rules(rules(event_meters(spark, folder)))
    sent = alerts.outbox(alerts.events_of(evaluated), all_rules, alerts.states(evaluated))

    def text(path: str):
        return F.get_json_object("payload", path)

    return sent.select(
        "workspace_id",
        text("$.rule.id").alias("rule_id"),
        text("$.event.type").alias("type"),
        text("$.state.status").alias("status"),
        F.coalesce(text("$.event.group_value"), F.lit("")).alias("group_value"),
        text("$.rule.meter").alias("meter_name"),
        F.round(text("$.event.value").cast("double"), 4).alias("value"),
        text("$.rule.window_seconds").cast("long").alias("window_seconds"),
        text("$.event.created_at").alias("created_at"),
    )


# Every tick of every rule against every event, brute force; the 60-second rules too.
_BACKTEST = ctes(
    EV,
    MET,
    _KINDS,
    _RULES,
    _EVK,
    """tck AS (SELECT r.*, i AS tick, TIMESTAMP '2024-01-10' + to_seconds(i * step) AS tick_at
  FROM rul r, range(0, 10081) t(i) WHERE enabled AND i * step <= 7 * 86400)""",
    f"""hits AS (SELECT r.workspace_id, r.rule_id, r.group_key, {_GROUP_VALUE} AS group_value, r.tick, any_value(r.step) AS step,
  any_value(r.comparator) AS comparator, any_value(r.threshold) AS threshold, {_MEASURE} AS value, count(*) AS event_count
  FROM tck r JOIN evk e ON e.workspace_id = r.workspace_id AND e.meter_name = r.meter_name
   AND e.event_time >= tick_at - to_seconds(window_seconds) AND e.event_time < tick_at AND (kind <> 'k42' OR e.k = '42')
  GROUP BY 1, 2, 3, 4, 5)""",
    f"""jdg AS (SELECT *, CASE WHEN {_HIT} THEN 'alerting' ELSE 'ok' END AS status FROM hits)""",
    """near AS (SELECT workspace_id, rule_id, group_key, group_value, step, tick, status, value FROM jdg
  UNION ALL SELECT workspace_id, rule_id, group_key, group_value, step, tick + 1, 'no_data', 0.0 FROM jdg a
  WHERE (tick + 1) * step <= 7 * 86400 AND NOT EXISTS (SELECT 1 FROM jdg b
    WHERE b.rule_id = a.rule_id AND b.group_value = a.group_value AND b.tick = a.tick + 1))""",
    """moved AS (SELECT *, TIMESTAMP '2024-01-10' + to_seconds(tick * step) AS tick_at,
  lag(status) OVER (PARTITION BY rule_id, group_value ORDER BY tick) AS before FROM near)""",
)


def _backtest_inputs(spark, folder):
    usage, meters = usage_from_events(spark, folder), event_meters(spark, folder)
    return materialize(rules(meters), "rules"), usage, meters


@query(
    "alert_backtest",
    _BACKTEST
    + """SELECT workspace_id, rule_id, group_key, group_value, tick_at AS at,
  CASE WHEN status = 'alerting' THEN 'triggered' ELSE 'resolved' END AS type, round(value, 6) AS value FROM moved
WHERE (status = 'alerting' AND before IS DISTINCT FROM 'alerting') OR (status <> 'alerting' AND before = 'alerting')""",
)
def alert_backtest(spark, folder):
    rows = alerts.backtest(*_backtest_inputs(spark, folder), "2024-01-10T00:00:00Z", "2024-01-17T00:00:00Z")
    return rounded(rows, "value")


@query(
    "alert_backtest_values",
    _BACKTEST
    + """SELECT workspace_id, rule_id, group_key, group_value, CAST(tick AS BIGINT) AS tick, round(value, 6) AS value, event_count, status
FROM jdg""",
)
def alert_backtest_values(spark, folder):
    rows = alerts.backtest_values(*_backtest_inputs(spark, folder), "2024-01-10T00:00:00Z", "2024-01-17T00:00:00Z")
    return rounded(rows.drop("interval_seconds", "tick_at"), "value")


# --- rules -------------------------------------------------------------------------------------


@query(
    "alert_due_rules",
    ctes(EV, MET, _KINDS, _RULES)
    + """SELECT rule_id, TIMESTAMP '2024-01-25 12:00:00' + to_seconds(step) AS next_evaluate_at FROM rul WHERE enabled""",
)
def alert_due_rules(spark, folder):
    due = alerts.due_rules(rules(event_meters(spark, folder)), NOW)
    return alerts.reschedule(due, NOW).select("rule_id", "next_evaluate_at")


@query(
    "alert_rule_validation",
    """SELECT 'ws' AS workspace_id, CAST(p_partkey AS VARCHAR) AS rule_id,
  CASE WHEN p_type = 'ECONOMY' THEN 'meter is required'
       WHEN p_size < 5 THEN 'window must be at least 1m0s'
       WHEN p_brand = 'Brand#7' THEN 'unsupported comparator'
       WHEN p_size > 40 THEN 'evaluation interval cannot exceed 24h0m0s'
       ELSE 'unsupported alert group field' END AS message
FROM part WHERE p_type = 'ECONOMY' OR p_size < 5 OR p_brand = 'Brand#7' OR p_size > 40 OR p_name LIKE 'red %'""",
)
def alert_rule_validation(spark, folder):
    """Parts as rules: size gives window and interval, brand the comparator."""
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("rule_id"),
        F.lit("ws").alias("workspace_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "  ").otherwise("meter").alias("meter_name"),
        F.lit(True).alias("enabled"),
        F.lit(None).cast("string").alias("subject"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        (size * 12).cast("long").alias("window_seconds"),
        F.when(F.col("p_brand") == "Brand#7", "above").otherwise("").alias("comparator"),
        F.col("p_retailprice").alias("threshold"),
        F.when(size > 40, 86401).otherwise(0).cast("long").alias("evaluation_interval_seconds"),
        F.when(F.col("p_name").startswith("red "), F.col("p_name")).otherwise("metadata.k").alias("group_by"),
        F.lit(None).cast("timestamp_ntz").alias("next_evaluate_at"),
    )
    return alerts.validate_rules(rows)


# --- history ---------------------------------------------------------------------------------------


@query(
    "event_latest_delivery",
    """WITH d AS (SELECT l_orderkey, l_shipdate, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' ||
    CAST(l_partkey AS VARCHAR) AS delivery_id, l_linestatus FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, delivery_id DESC) AS rn FROM d)
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type, r.delivery_id, r.l_linestatus AS delivery_status,
  r.l_shipdate AS delivery_attempted_at
FROM orders LEFT JOIN r ON r.l_orderkey = o_orderkey AND rn = 1""",
)
def event_latest_delivery(spark, folder):
    """Orders as alert events, their line items as delivery attempts."""
    events, deliveries = _orders_as_alerts(spark, folder)
    return with_latest_delivery(events.select("id", "type"), deliveries)


def _orders_as_alerts(spark, folder) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderdate").alias("created_at"),
    )
    line = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    deliveries = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.concat_ws("/", *line).alias("delivery_id"),
        F.col("l_shipdate").alias("attempted_at"),
        F.col("l_linestatus").alias("status"),
    )
    return events, deliveries


@query(
    "alert_event_history",
    """WITH d AS (SELECT l_orderkey, l_shipdate, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' ||
    CAST(l_partkey AS VARCHAR) AS delivery_id, l_linestatus FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, delivery_id DESC) AS rn FROM d),
p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type, o_orderdate AS created_at FROM orders
  WHERE o_orderdate < TIMESTAMP '2000-01-01' OR (o_orderdate = TIMESTAMP '2000-01-01' AND CAST(o_orderkey AS VARCHAR) < '5')
  ORDER BY o_orderdate DESC, id DESC LIMIT 51)
SELECT p.id, p.type, p.created_at, r.delivery_id, r.l_linestatus AS delivery_status, r.l_shipdate AS delivery_attempted_at
FROM p LEFT JOIN r ON CAST(r.l_orderkey AS VARCHAR) = p.id AND rn = 1""",
)
def alert_event_history(spark, folder):
    events, deliveries = _orders_as_alerts(spark, folder)
    return alerts.event_history(events, deliveries, 50, (datetime(2000, 1, 1), "5"))


@query(
    "alert_states_of_known_rules",
    ctes(EV, MET)
    + """SELECT e.workspace_id, e.id AS rule_id, e.meter_name FROM (SELECT id, workspace_id, meter_name FROM ev) e
WHERE EXISTS (SELECT 1 FROM met m WHERE m.workspace_id = e.workspace_id AND m.name = e.meter_name AND m.name <> 'view')""",
)
def alert_states_of_known_rules(spark, folder):
    usage = usage_from_events(spark, folder)
    rows = usage.select("workspace_id", F.col("meter_name").alias("rule_id"), "id")
    known = event_meters(spark, folder).filter("name <> 'view'").select("workspace_id", F.col("name").alias("rule_id"))
    kept = alerts.of_known_rules(rows, known)
    return kept.select("workspace_id", F.col("id").alias("rule_id"), F.col("rule_id").alias("meter_name"))
