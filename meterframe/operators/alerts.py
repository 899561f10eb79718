"""Threshold alerts: evaluation, state transitions, backtest, history and outbox.

All due rules are evaluated in one pass over the events: each event meets the rules of
its meter, and is reduced to (rule, group) partials before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.functions.aggregates import merge_partials, merged, partial_of_events, partial_value
from meterframe.functions.metadata import json_path_column, json_text, only_keys, top_key
from meterframe.functions.predicates import metadata_map_matches, metadata_map_matches_strictly
from meterframe.functions.timecalc import ntz, plus_seconds, rfc3339, seconds_between, utc_naive
from meterframe.operators.ingest import subject_error
from meterframe.operators.joins import dealt_out, fits, side_join, with_latest_delivery
from meterframe.operators.paging import LOG_ORDER, page
from meterframe.operators.scan import scan
from meterframe.schema import COMPARATORS, DIMENSION_NAME_PATTERN, NAME_MAX_CHARS
from meterframe.session import materialize

OK, ALERTING, NO_DATA, ERROR = "ok", "alerting", "no_data", "error"
GROUP = ["workspace_id", "rule_id", "group_key", "group_value"]

# Fixed values of the rule model, in seconds.
WINDOW_DEFAULT, WINDOW_MIN, WINDOW_MAX = 3600, 60, 366 * 86400
INTERVAL_DEFAULT, INTERVAL_MIN, INTERVAL_MAX = 60, 1, 86400

TICKS_PER_PIECE = 4096

# Panes divide the shortest window. A window is looked up among the panes of its class only,
# so a short rule does not meet the panes of a long one.
PANE_SECONDS = 60
PANE_KEY = ["workspace_id", "meter_name", "subject", "metadata", "event_time", "received_at"]
WINDOW_CLASSES = (3600, 86400, 32 * 86400, WINDOW_MAX)


# --- rules -------------------------------------------------------------------------


def normalize_rules(rules: DataFrame) -> DataFrame:
    """Trimmed names, defaults for window, interval and comparator, plain group field."""

    def default(name: str, value) -> Column:
        return F.when(F.coalesce(name, F.lit(0)) == 0, value).otherwise(F.col(name)).cast("long")

    group_by = F.regexp_replace(F.trim(F.coalesce("group_by", F.lit(""))), r"^metadata\.", "")
    return rules.withColumns(
        {
            "name": F.trim("name"),
            "meter_name": F.trim("meter_name"),
            "subject": F.trim(F.coalesce("subject", F.lit(""))),
            "window_seconds": default("window_seconds", WINDOW_DEFAULT),
            "evaluation_interval_seconds": default("evaluation_interval_seconds", INTERVAL_DEFAULT),
            "comparator": F.coalesce(F.nullif(F.col("comparator"), F.lit("")), F.lit("gte")),
            "group_by": group_by,
        }
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rule breaks as `(workspace_id, rule_id, message)`; the first one per rule."""
    clean = normalize_rules(rules)
    name, meter = F.coalesce("name", F.lit("")), F.coalesce("meter_name", F.lit(""))
    window, interval = F.col("window_seconds"), F.col("evaluation_interval_seconds")
    threshold, group_by = F.col("threshold"), F.col("group_by")
    has_blank = F.coalesce(
        F.exists(F.map_entries("metadata"), lambda e: (F.trim(e["key"]) == "") | (F.trim(e["value"]) == "")),
        F.lit(False),
    )
    infinite = F.abs(threshold) == F.lit(float("inf"))
    message = (
        F.when(name == "", "name is required")
        .when(F.char_length(name) > NAME_MAX_CHARS, "name is too long")
        .when(meter == "", "meter is required")
        .when((F.col("subject") != "") & subject_error(F.col("subject")).isNotNull(), subject_error(F.col("subject")))
        .when(has_blank, "metadata filter key and value are required")
        .when(window < WINDOW_MIN, "window must be at least 1m0s")
        .when(window > WINDOW_MAX, "window cannot exceed 8784h0m0s")
        .when(~F.col("comparator").isin(*COMPARATORS), "unsupported comparator")
        .when(threshold.isNull() | F.isnan(threshold) | infinite, "threshold must be finite")
        .when(interval < INTERVAL_MIN, "evaluation interval must be at least 1s")
        .when(interval > INTERVAL_MAX, "evaluation interval cannot exceed 24h0m0s")
        .when((group_by != "") & ~group_by.rlike(DIMENSION_NAME_PATTERN), "unsupported alert group field")
    )
    return clean.select("workspace_id", "rule_id", message.alias("message")).filter(F.col("message").isNotNull())


def due_rules(rules: DataFrame, now: str | datetime) -> DataFrame:
    """Enabled rules whose next evaluation time has come."""
    return rules.filter(F.col("enabled") & (F.col("next_evaluate_at") <= ntz(now)))


def reschedule(rules: DataFrame, now: str | datetime) -> DataFrame:
    """Rules with their next evaluation one interval after `now`."""
    return rules.withColumn("next_evaluate_at", plus_seconds(ntz(now), F.col("evaluation_interval_seconds")))


def compare(comparator: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(comparator == "gt", value > threshold)
        .when(comparator == "lt", value < threshold)
        .when(comparator == "lte", value <= threshold)
        .when(comparator == "eq", value == threshold)
        .when(comparator == "neq", value != threshold)
        .otherwise(value >= threshold)
    )


# --- evaluation ----------------------------------------------------------------------


def _rule_side(rules: DataFrame, meters: DataFrame) -> DataFrame:
    """Rules with their meter's aggregation, columns prefixed so they cannot clash."""
    aggregation = meters.select("workspace_id", F.col("name").alias("meter_name"), "aggregation")
    return rules.join(aggregation, ["workspace_id", "meter_name"]).select(
        "workspace_id",
        "meter_name",
        "rule_id",
        F.col("subject").alias("rule_subject"),
        F.col("metadata").alias("rule_metadata"),
        F.col("group_by").alias("group_key"),
        json_path_column(F.col("group_by")).alias("group_path"),
        F.col("aggregation").alias("rule_aggregation"),
        "window_seconds",
        "evaluation_interval_seconds",
        "comparator",
        "threshold",
    )


@dataclass
class RuleFacts:
    """What the plan needs to know about the rules; one row read by the driver."""

    longest_window: int
    ordered: bool  # some rule needs first or last
    small: bool  # the rules may be broadcast

    @classmethod
    def of(cls, side: DataFrame) -> "RuleFacts":
        ordered = F.col("rule_aggregation").isin("first", "last")
        row = side.agg(
            F.max("window_seconds").alias("longest"),
            F.max(ordered).alias("ordered"),
        ).first()
        return cls(int(row["longest"] or 0), bool(row["ordered"]), fits(side))


def _match(
    events: DataFrame,
    rules: DataFrame,
    facts: RuleFacts,
    in_window: Column | None = None,
    spread: Column | None = None,
) -> DataFrame:
    """Events (or panes) joined with the rules they count for, plus their group value.

    Metadata conditions of global rules compare as text, those of grouped rules by JSON type. Events without a group value do not count for grouped rules.
    """
    subject = F.col("rule_subject")
    wanted, metadata = F.col("rule_metadata"), F.col("metadata")
    as_text, strictly = metadata_map_matches(wanted, metadata), metadata_map_matches_strictly(wanted, metadata)
    same_metadata = F.when(F.col("group_key") == "", as_text).otherwise(strictly)
    residual = (subject.isNull() | (subject == "") | (subject == F.col("subject"))) & same_metadata
    if in_window is not None:
        residual = residual & in_window
    joined = side_join(events, rules, ["workspace_id", "meter_name"], "inner", residual, spread, small=facts.small)
    group_value = (
        F.when(F.col("group_key") == "", "")
        .when(F.col("group_key") == "subject", F.col("subject"))
        .otherwise(json_text(F.col("metadata"), F.col("group_path")))
    )
    valued = joined.withColumn("group_value", group_value)
    return valued.filter((F.col("group_key") == "") | (F.coalesce("group_value", F.lit("")) != ""))


def rule_values(
    rules: DataFrame, events: DataFrame, meters: DataFrame, now: str | datetime
) -> DataFrame:
    """Value and event count per (rule, group) over `[now - window, now)`."""
    side = _rule_side(rules, meters)
    facts = RuleFacts.of(side)
    end = utc_naive(now)
    recent = scan(events, start=end - timedelta(seconds=facts.longest_window), end=end)
    in_window = F.col("event_time") >= plus_seconds(ntz(now), -F.col("window_seconds"))
    matched = _match(recent, side, facts, in_window)
    partials = matched.groupBy(*GROUP, "rule_aggregation", "window_seconds").agg(*partial_of_events(facts.ordered))
    return partials.select(*GROUP, _value(facts.ordered).alias("value"), F.col("event_count").alias("usage_events"))


def pane_partials(events: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Events reduced to panes of `PANE_SECONDS`: per meter, subject and values of some metadata fields.

    `event_time` is the pane's start and `metadata` holds the fields' top-level entries only, so
    panes meet rules, cutoffs and time ranges the way events do. Panes of the same key, from
    whatever batch, merge.
    """
    keys = list(dict.fromkeys(top_key(field) for field in fields))
    start = F.col("event_time") - F.make_dt_interval(
        secs=F.pmod(seconds_between(ntz("1970-01-01T00:00:00Z"), F.col("event_time")), F.lit(PANE_SECONDS)).cast("decimal(18,6)")
    )
    keyed = events.select(
        "*", only_keys(keys).alias("__metadata"), start.alias("__start")
    ).groupBy(
        "workspace_id",
        "meter_name",
        "subject",
        F.col("__metadata").alias("metadata"),
        F.col("__start").alias("event_time"),
        "received_at",
    )
    return keyed.agg(*partial_of_events())


def of_panes(fields: tuple[str, ...]) -> Column:
    """Whether panes that hold `fields` answer a (normalized) rule: whole panes in its window, no other field."""
    known = F.array(*[F.lit(key) for key in dict.fromkeys(top_key(field) for field in fields)]).cast("array<string>")

    def held(path: Column) -> Column:
        return F.array_contains(known, F.substring_index(path, ".", 1))

    conditions = F.coalesce(F.forall(F.map_keys("metadata"), held), F.lit(True))
    grouped = F.col("group_by").isin("", "subject") | held(F.col("group_by"))
    return (F.col("window_seconds") % PANE_SECONDS == 0) & grouped & conditions


def on_pane_edge(moment: str | datetime) -> bool:
    at = utc_naive(moment)
    return at.second % PANE_SECONDS == 0 and at.microsecond == 0


def pane_values(rules: DataFrame, panes: DataFrame, meters: DataFrame, now: str | datetime) -> DataFrame:
    """`rule_values` from panes; `now` lies on a pane's edge and `of_panes` holds for the rules.

    The rules are split by the length of their window. Each class reads the panes of its own
    longest window, whatever the other rules look back to.
    """
    side = _rule_side(rules, meters)
    facts, end = RuleFacts.of(side), utc_naive(now)
    classes = list(zip((0, *WINDOW_CLASSES), WINDOW_CLASSES))
    window = F.col("window_seconds")
    in_class = [(window > low) & (window <= high) for low, high in classes]
    row = side.agg(*[F.max(F.when(test, window)).alias(f"c{i}") for i, test in enumerate(in_class)]).first()
    in_window = F.col("event_time") >= plus_seconds(ntz(now), -window)
    spread = F.xxhash64("subject", "metadata", "event_time")
    matched = [
        _match(scan(panes, start=end - timedelta(seconds=longest), end=end), side.filter(test), facts, in_window, spread)
        for test, longest in zip(in_class, row)
        if longest is not None
    ]
    if not matched:
        matched = [_match(panes.limit(0), side, facts, in_window, spread)]
    partials = [
        part.groupBy(*GROUP, "rule_aggregation", "window_seconds").agg(*merge_partials(facts.ordered)) for part in matched
    ]
    # A rule is in one class, so the classes' groups need no further merge.
    values = reduce(DataFrame.unionByName, partials)
    return values.select(*GROUP, _value(facts.ordered).alias("value"), F.col("event_count").alias("usage_events"))


def _value(ordered: bool) -> Column:
    absent = None if ordered else F.lit(None).cast("double")
    return partial_value(F.col("rule_aggregation"), F.col("window_seconds").cast("double"), absent, absent)


def group_suffix(key: Column, value: Column) -> Column:
    return F.when((key == "") & (value == ""), "").otherwise(F.concat(F.lit(" for "), key, F.lit(" "), value))


def _message(status: Column) -> Column:
    over = F.format_string("value %.4f %s threshold %.4f", "value", "comparator", "threshold")
    within = F.format_string("value %.4f is within threshold %.4f", "value", "threshold")
    text = (
        F.when(status == NO_DATA, "no usage data in alert window").when(status == ALERTING, over).otherwise(within)
    )
    return F.concat(text, group_suffix(F.col("group_key"), F.col("group_value")))


def evaluate(
    rules: DataFrame,
    events: DataFrame,
    meters: DataFrame,
    previous: DataFrame,
    now: str | datetime,
    values: DataFrame | None = None,
) -> DataFrame:
    """New state per (rule, group), with `previous_status` and `event_type`.

    `values` are the enabled rules' values where the caller has them, as a store with panes does.

    * a rule or group without events is `no_data`; a remembered group that vanished too;
    * a grouped rule that has and had no group at all gets one row with an empty group;
    * a disabled rule is `ok`.

    `event_type` is `triggered` on entering alerting, `resolved` on leaving it.
    """
    rules = normalize_rules(rules)
    enabled = rules.filter("enabled")
    rule_columns = enabled.select(
        "workspace_id", "rule_id", F.col("group_by").alias("rule_group"), "comparator", "threshold"
    )
    # New values meet remembered groups in one aggregation: a group is there if it has
    # events now or had a state before.
    values = rule_values(enabled, events, meters, now) if values is None else values
    new = values.select(*GROUP, "value", "usage_events", F.lit(None).cast("string").alias("previous_status"))
    before = previous.select(
        *GROUP,
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("long").alias("usage_events"),
        F.col("status").alias("previous_status"),
    )
    groups = (
        new.unionByName(before)
        .groupBy(*GROUP)
        .agg(*[F.max(c).alias(c) for c in ("value", "usage_events", "previous_status")])
    )
    # Used twice below; written, so that the events are read once.
    groups = materialize(groups, "alert-groups")
    same_kind = (F.col("rule_group") == "") == (F.col("group_key") == "")
    with_rule = groups.join(rule_columns, ["workspace_id", "rule_id"]).filter(same_kind).drop("rule_group")

    # Rules without any group: global ones without events, grouped ones never seen.
    silent = (
        rule_columns.drop("rule_group")
        .join(with_rule.select("workspace_id", "rule_id").distinct(), ["workspace_id", "rule_id"], "left_anti")
        .withColumns(
            {
                "group_key": F.lit(""),
                "group_value": F.lit(""),
                "value": F.lit(None).cast("double"),
                "usage_events": F.lit(None).cast("long"),
                "previous_status": F.lit(None).cast("string"),
            }
        )
    )
    rows = with_rule.unionByName(silent).withColumns(
        {"value": F.coalesce("value", F.lit(0.0)), "usage_events": F.coalesce("usage_events", F.lit(0)).cast("long")}
    )
    hit = compare(F.col("comparator"), F.col("value"), F.col("threshold"))
    status = F.when(F.col("usage_events") == 0, NO_DATA).when(hit, ALERTING).otherwise(OK)
    judged = rows.withColumn("status", status).withColumn("message", _message(F.col("status")))

    disabled = rules.filter(~F.col("enabled")).select(
        "workspace_id",
        "rule_id",
        F.lit("").alias("group_key"),
        F.lit("").alias("group_value"),
        F.lit(0.0).alias("value"),
        F.lit(0).cast("long").alias("usage_events"),
        F.lit(None).cast("string").alias("previous_status"),
        F.lit(OK).alias("status"),
        F.lit("alert rule is disabled").alias("message"),
    )
    result = judged.drop("comparator", "threshold").unionByName(disabled)
    return result.select(
        *GROUP,
        "status",
        "value",
        "usage_events",
        "message",
        "previous_status",
        transition_type(F.col("previous_status"), F.col("status")).alias("event_type"),
        ntz(now).alias("evaluated_at"),
    )


def transition_type(previous: Column, status: Column) -> Column:
    was = F.coalesce(previous == ALERTING, F.lit(False))
    return F.when((status == ALERTING) & ~was, "triggered").when(was & (status != ALERTING), "resolved")


def states(evaluated: DataFrame) -> DataFrame:
    """State rows in the layout that `evaluate` takes as `previous`."""
    return evaluated.select(
        *GROUP, "status", "value", "message", "evaluated_at", F.col("evaluated_at").alias("updated_at")
    )


def events_of(evaluated: DataFrame) -> DataFrame:
    """Triggered and resolved events; ids hash the group and time, so a retry repeats them."""
    identity = F.concat_ws("|", *GROUP, F.col("evaluated_at").cast("string"))
    return evaluated.filter(F.col("event_type").isNotNull()).select(
        F.sha2(identity, 256).alias("id"),
        *GROUP,
        F.col("event_type").alias("type"),
        "value",
        "message",
        F.col("evaluated_at").alias("created_at"),
    )


# --- reading states -------------------------------------------------------------------


def priority(status: Column) -> Column:
    return F.when(status == ALERTING, 0).when(status == ERROR, 1).when(status == NO_DATA, 2).otherwise(3)


def by_priority(state_rows: DataFrame, limit: int) -> DataFrame:
    """States, worst first, then newest, then by group."""
    order = [priority(F.col("status")), F.desc("updated_at"), "rule_id", "group_key", "group_value"]
    return state_rows.orderBy(*order).limit(limit)


def primary_state(state_rows: DataFrame) -> DataFrame:
    """Each rule's worst state; the newest one among equals, then the first group."""
    rest = [c for c in state_rows.columns if c not in ("workspace_id", "rule_id")]
    newest_first = seconds_between(F.col("updated_at"), F.lit("9999-01-01 00:00:00").cast("timestamp_ntz"))
    order = F.struct(priority(F.col("status")), newest_first, F.col("group_key"), F.col("group_value"))
    pick = F.min_by(F.struct(*rest), order).alias("pick")
    return state_rows.groupBy("workspace_id", "rule_id").agg(pick).select("workspace_id", "rule_id", "pick.*")


def of_known_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose rule exists in the same workspace."""
    return rows.join(rules.select("workspace_id", "rule_id"), ["workspace_id", "rule_id"], "left_semi")


def event_history(alert_events: DataFrame, deliveries: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Alert events, newest first, with the latest delivery of each.

    The page is cut before the join: only its rows meet the deliveries.
    """
    newest = page(alert_events, LOG_ORDER, limit, after)
    ids = newest.select(F.col("id").alias("event_id"))
    return with_latest_delivery(newest, deliveries.join(ids, "event_id", "left_semi"))


def outbox(alert_events: DataFrame, rules: DataFrame, state_rows: DataFrame) -> DataFrame:
    """One JSON notification per alert event with its rule and group state."""
    rule = rules.select(
        "workspace_id",
        "rule_id",
        F.struct(
            F.col("rule_id").alias("id"),
            "name",
            F.col("meter_name").alias("meter"),
            "enabled",
            F.nullif(F.col("subject"), F.lit("")).alias("subject"),
            F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"),
            "window_seconds",
            "comparator",
            "threshold",
            "evaluation_interval_seconds",
            F.nullif(F.col("group_by"), F.lit("")).alias("group_by"),
        ).alias("rule"),
    )
    state = state_rows.select(
        *GROUP,
        F.struct(
            "status",
            F.nullif(F.col("group_key"), F.lit("")).alias("group_key"),
            F.nullif(F.col("group_value"), F.lit("")).alias("group_value"),
            "value",
            "message",
            rfc3339(F.col("evaluated_at")).alias("evaluated_at"),
            rfc3339(F.col("updated_at")).alias("updated_at"),
        ).alias("state"),
    )
    event = F.struct(
        "id",
        "rule_id",
        F.nullif(F.col("group_key"), F.lit("")).alias("group_key"),
        F.nullif(F.col("group_value"), F.lit("")).alias("group_value"),
        "type",
        "value",
        "message",
        rfc3339(F.col("created_at")).alias("created_at"),
    )
    joined = alert_events.join(rule, ["workspace_id", "rule_id"]).join(state, GROUP, "left")
    return joined.select(
        F.col("id").alias("event_id"),
        "workspace_id",
        F.to_json(F.struct(event.alias("event"), "rule", "state")).alias("payload"),
    )


# --- backtest --------------------------------------------------------------------------


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; Euclid needs at most 91 rounds for any two longs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(
        s["b"] > 0, F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step)["a"]


RULE_COLUMNS = [
    *GROUP,
    "rule_aggregation",
    "window_seconds",
    "evaluation_interval_seconds",
    "pane_seconds",
    "comparator",
    "threshold",
]


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def backtest_runs(
    rules: DataFrame,
    events: DataFrame,
    meters: DataFrame,
    start: str | datetime,
    end: str | datetime,
) -> DataFrame:
    """Per (rule, group): runs of ticks `first_tick..last_tick` whose windows hold the same events.

    Tick i is at `start + i * interval`, up to `end`, and looks back one window. Ticks
    without events are in no run. Events reduce to panes of the greatest common divisor
    of window and interval, `span` panes to a window; a value can only change at a tick
    where a pane enters or leaves, so there are at most two ticks to look at per pane,
    however short the interval. The panes are cut into blocks of `span`: a window is the
    tail of one block and the head of the next, and both are running aggregates within
    their block. Nothing is copied per tick, and no frame is wider than a block.
    """
    begin, finish = utc_naive(start), utc_naive(end)
    side = _rule_side(normalize_rules(rules).filter("enabled"), meters)
    facts = RuleFacts.of(side)
    ordered = facts.ordered
    side = side.withColumn("pane_seconds", _gcd(F.col("window_seconds"), F.col("evaluation_interval_seconds")))
    recent = scan(events, start=begin - timedelta(seconds=facts.longest_window), end=finish)
    matched = _match(recent, side, facts)
    pane = F.floor(seconds_between(ntz(start), F.col("event_time")) / F.col("pane_seconds")).cast("long")
    panes = matched.groupBy(*RULE_COLUMNS, pane.alias("at")).agg(*partial_of_events(ordered))
    # Used twice below; written, so that the events are read once.
    panes = materialize(panes, "backtest-panes")

    span = _floor_div(F.col("window_seconds"), F.col("pane_seconds"))
    stride = _floor_div(F.col("evaluation_interval_seconds"), F.col("pane_seconds"))
    final_tick = _floor_div(F.lit(int((finish - begin).total_seconds())), F.col("evaluation_interval_seconds"))
    # The window of tick t holds the panes t * stride - span .. t * stride - 1.
    enters = F.greatest(_floor_div(F.col("at"), stride) + 1, F.lit(0))
    leaves = _floor_div(F.col("at") + span, stride) + 1
    changes = (
        panes.select(*RULE_COLUMNS, F.explode(F.array(enters, leaves)).alias("tick"))
        .filter((F.col("tick") >= 0) & (F.col("tick") <= final_tick))
        .distinct()
    )
    low, high = F.col("tick") * stride - span, F.col("tick") * stride - 1
    tail = F.struct(F.lit("tail").alias("part"), low.alias("at"))
    head = F.struct(F.lit("head").alias("part"), high.alias("at"))
    aligned = F.pmod(low, span) == 0  # the tail is the whole window
    parts = F.when(aligned, F.array(tail)).otherwise(F.array(tail, head))
    looks = changes.select(*RULE_COLUMNS, "tick", F.inline(parts))
    block = _floor_div(F.col("at"), span)
    rows = panes.unionByName(looks, allowMissingColumns=True).withColumn("block", block)
    # Both frames sort all rows of a task, so the tasks are kept small. The threshold is left out: as a
    # window's key Spark normalizes a double, and then it would shuffle the rows again.
    rows = dealt_out(rows, *GROUP, "block")
    in_block = Window.partitionBy(*RULE_COLUMNS, "block").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forward, backward = in_block.orderBy("at"), in_block.orderBy(F.desc("at"))
    running = [
        F.when(F.col("part") == "tail", column.over(backward)).otherwise(column.over(forward)).alias(name)
        for name, column in merged(ordered).items()
    ]
    looked = rows.select(*RULE_COLUMNS, "tick", *running)
    per_tick = looked.filter(F.col("tick").isNotNull()).groupBy(*RULE_COLUMNS, "tick").agg(*merge_partials(ordered))

    next_change = F.lead("tick").over(Window.partitionBy(*RULE_COLUMNS).orderBy("tick"))
    hit = compare(F.col("comparator"), F.col("value"), F.col("threshold"))
    return (
        per_tick.withColumn("last_tick", F.coalesce(next_change - 1, final_tick))
        .filter(F.col("event_count") > 0)
        .withColumn("value", _value(ordered))
        .withColumn("status", F.when(hit, ALERTING).otherwise(OK))
        .select(
            *GROUP,
            F.col("evaluation_interval_seconds").alias("interval_seconds"),
            F.col("tick").alias("first_tick"),
            "last_tick",
            "value",
            "event_count",
            "status",
        )
    )


def _tick_at(start: str | datetime, tick: Column) -> Column:
    return plus_seconds(ntz(start), tick * F.col("interval_seconds"))


def backtest_values(
    rules: DataFrame,
    events: DataFrame,
    meters: DataFrame,
    start: str | datetime,
    end: str | datetime,
) -> DataFrame:
    """Value per (rule, group, tick) for ticks that have events in their window.

    The runs are written out tick by tick, in two steps, so that no array is long.
    """
    runs = backtest_runs(rules, events, meters, start, end)
    length = F.col("last_tick") - F.col("first_tick") + 1
    pieces = F.sequence(F.lit(0).cast("long"), _floor_div(length - 1, F.lit(TICKS_PER_PIECE)))
    piece_start = F.col("first_tick") + F.col("piece") * TICKS_PER_PIECE
    piece_end = F.least(piece_start + (TICKS_PER_PIECE - 1), F.col("last_tick"))
    ticks = runs.withColumn("piece", F.explode(pieces)).withColumn("tick", F.explode(F.sequence(piece_start, piece_end)))
    tick_at = _tick_at(start, F.col("tick"))
    return ticks.select(*GROUP, "interval_seconds", "tick", tick_at.alias("tick_at"), "value", "event_count", "status")


def backtest(
    rules: DataFrame,
    events: DataFrame,
    meters: DataFrame,
    start: str | datetime,
    end: str | datetime,
) -> DataFrame:
    """Triggered and resolved events the rules would have raised between two times.

    Ticks without events are `no_data`. They are not materialised: a gap after a run
    means the next tick had no data, which resolves an alerting group there.
    """
    runs = backtest_runs(rules, events, meters, start, end)
    history = Window.partitionBy(*GROUP).orderBy("first_tick")
    total = (utc_naive(end) - utc_naive(start)).total_seconds()
    adjoins = F.lag("last_tick").over(history) == F.col("first_tick") - 1
    seen = runs.withColumns(
        {
            "before": F.when(adjoins, F.lag("status").over(history)),
            "gap_after": F.coalesce(F.lead("first_tick").over(history) > F.col("last_tick") + 1, F.lit(True)),
            "has_next": (F.col("last_tick") + 1) * F.col("interval_seconds") <= total,
        }
    )
    here = transition_type(F.col("before"), F.col("status"))
    vanishes = (F.col("status") == ALERTING) & F.col("gap_after") & F.col("has_next")
    now_event = F.when(
        here.isNotNull(),
        F.struct(_tick_at(start, F.col("first_tick")).alias("at"), here.alias("type"), F.col("value").alias("value")),
    )
    next_event = F.when(
        vanishes,
        F.struct(
            _tick_at(start, F.col("last_tick") + 1).alias("at"),
            F.lit("resolved").alias("type"),
            F.lit(0.0).alias("value"),
        ),
    )
    return seen.select(*GROUP, F.inline(F.array_compact(F.array(now_event, next_event))))
