"""Plans, assignments, quota counters, progress, checks and transitions.

Counters are the only place where events are read. Everything after them works on
one row per (subject, meter, period window), so the cost of a quota question does
not depend on the number of events.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.functions.aggregates import (
    PARTIAL_COLUMNS,
    merge_partials,
    partial_of_events,
    partial_value,
)
from meterframe.functions.timecalc import (
    day_boundary,
    day_index,
    ntz,
    seconds_between,
    truncated_to_second,
    windows_until,
    with_window_of,
    with_windows,
)
from meterframe.operators.joins import dealt_out, fits, side_join
from meterframe.schema import NAME_MAX_CHARS, PERIODS, WARNING_DEFAULT_PERCENT
from meterframe.session import materialize

OK, WARNING, EXCEEDED = "ok", "warning", "exceeded"
NO_PLAN, NOT_IN_PLAN = "no_plan", "not_in_plan"
SUBJECT = ["workspace_id", "subject"]
COUNTER_KEY = ["workspace_id", "subject", "meter_name", "period", "period_start", "period_end"]


# --- assignments -------------------------------------------------------------------


def forever() -> Column:
    """The end of an assignment that has none, where ends are compared."""
    return F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")


def not_ended(at: Column) -> Column:
    return F.col("unassigned_at").isNull() | (F.col("unassigned_at") > at)


def assignment_status(now: str | datetime) -> Column:
    at = ntz(now)
    return F.when(F.col("assigned_at") > at, "scheduled").when(not_ended(at), "active").otherwise("ended")


def assignment_at(assignments: DataFrame, at: str | datetime) -> DataFrame:
    """The assignment in effect at one time, per subject; the newest one wins."""
    moment = ntz(at)
    live = assignments.filter((F.col("assigned_at") <= moment) & not_ended(moment))
    rest = [c for c in assignments.columns if c not in SUBJECT]
    newest = F.max_by(F.struct(*rest), F.struct("assigned_at", "updated_at")).alias("newest")
    return live.groupBy(*SUBJECT).agg(newest).select(*SUBJECT, "newest.*").select(*assignments.columns)


def effective_intervals(assignments: DataFrame) -> DataFrame:
    """Assignments as disjoint `[valid_from, valid_to)` intervals.

    Cancelled rows (ended before they start) drop out; of the rows alive at a time the newest
    counts, so an older one comes back when a newer one ends before it. Each time has at most
    one interval and the event join needs no deduplication.

    A newer row usually ends an older one for good, and then intervals follow from the next
    start. Only the subjects with a row that outlives a newer one have their history cut at
    every start and end, each piece taking its newest row (`newest_pieces`).
    """
    real = assignments.filter(F.col("unassigned_at").isNull() | (F.col("unassigned_at") > F.col("assigned_at")))
    history = Window.partitionBy(*SUBJECT).orderBy("assigned_at", "updated_at")
    earlier = history.rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("unassigned_at", forever())
    shape = [*SUBJECT, "plan_id", "period_anchor_at", "valid_from", "valid_to"]
    marked = real.select(
        *SUBJECT,
        "plan_id",
        "period_anchor_at",
        "updated_at",
        F.col("assigned_at").alias("valid_from"),
        end.alias("ends"),
        F.least("unassigned_at", F.lead("assigned_at").over(history)).alias("valid_to"),
        F.coalesce(F.max(end).over(earlier) > end, F.lit(False)).alias("outlived"),
    )
    # Written, so that the history is sorted once however often the intervals are used.
    marked = materialize(marked, "assignment-history")
    lasting = F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))
    cut_up = marked.filter("outlived").select(*SUBJECT).distinct()
    if cut_up.isEmpty():
        return marked.filter(lasting).select(*shape)
    simple = marked.join(cut_up, SUBJECT, "left_anti").filter(lasting).select(*shape)
    pieces = newest_pieces(marked.join(cut_up, SUBJECT, "left_semi"))
    return simple.unionByName(materialize(pieces.select(*shape), "assignment-pieces"))


def newest_pieces(rows: DataFrame) -> DataFrame:
    """The time of each subject cut at every start and end of its rows, each piece with its newest row.

    Cuts are numbered from 1 per subject, so a row covers a range of pieces. The range falls into at
    most two aligned blocks of each power of two, each block keeps the newest row that
    covers it whole, and a piece looks at the blocks that it lies in: n log n rows for n
    overlapping ones, and never the product of rows and pieces. Equal rows count once.
    """
    row = F.struct("valid_from", "updated_at", "plan_id", "period_anchor_at").alias("row")
    number = F.dense_rank().over(Window.partitionBy(*SUBJECT).orderBy("cut")).cast("long")
    edges = rows.select(*SUBJECT, row, "ends", F.explode(F.array("valid_from", "ends")).alias("cut"))
    edges = edges.withColumn("at", number)

    covers = edges.groupBy(*SUBJECT, "row", "ends").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    levels = F.sequence(F.lit(0), F.length(F.bin("high")) - 1)

    def whole_blocks(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.call_function("shiftright", F.col("low") + size - 1, level)
        past = F.call_function("shiftright", F.col("high"), level)
        odd_first = F.when((first < past) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        odd_last = F.when((first < past) & (past % 2 == 1), F.struct(level.alias("level"), (past - 1).alias("block")))
        return F.array(odd_first, odd_last)

    blocks = F.explode(F.array_compact(F.flatten(F.transform(levels, whole_blocks))))
    newest = covers.select(*SUBJECT, "row", blocks.alias("node")).groupBy(*SUBJECT, "node").agg(F.max("row").alias("row"))

    # A cut begins its piece and ends the one before.
    starts = F.struct(F.col("at").alias("at"), F.col("cut").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("until"))
    stops = F.struct((F.col("at") - 1).alias("at"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.col("cut").alias("until"))
    pieces = edges.select(*SUBJECT, F.explode(F.array(starts, stops)).alias("piece")).groupBy(*SUBJECT, "piece.at")
    pieces = pieces.agg(F.max("piece.valid_from").alias("valid_from"), F.max("piece.until").alias("until")).filter("at > 0")

    def block_of(level: Column) -> Column:
        return F.struct(level.alias("level"), F.call_function("shiftright", F.col("at"), level).alias("block"))

    nodes = F.transform(F.sequence(F.lit(0), F.length(F.bin("at")) - 1), block_of)
    looks = pieces.select("*", F.explode(nodes).alias("node"))
    found = looks.join(newest, [*SUBJECT, "node"]).groupBy(*SUBJECT, "valid_from", "until").agg(F.max("row").alias("row"))
    return found.select(
        *SUBJECT,
        "row.plan_id",
        "row.period_anchor_at",
        "valid_from",
        F.when(F.col("until") < forever(), F.col("until")).alias("valid_to"),
    )


def with_assignment(
    events: DataFrame, assignments: DataFrame, how: str = "inner", keep_start: bool = False
) -> DataFrame:
    """Events with the plan and anchor in effect at their event time (as-of join)."""
    time = F.col("event_time")
    residual = (time >= F.col("valid_from")) & (F.col("valid_to").isNull() | (time < F.col("valid_to")))
    intervals = effective_intervals(assignments)
    joined = side_join(events, intervals, SUBJECT, how, residual, small=fits(intervals))
    return joined.drop("valid_to") if keep_start else joined.drop("valid_from", "valid_to")


def assign(assignments: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply assign commands to the history; returns the whole new history.

    Commands: `workspace_id, subject, plan_id, effective_at, issued_at, id`; those of
    one subject apply in `issued_at, id` order. Each command, at its issue time,
    cancels assignments that start later, ends the running one at its own start, and
    keeps the running one's period anchor. Without a running assignment the anchor is
    the start, truncated to the second. A start in the past becomes the issue time.

    All of this follows from window functions over one subject's history:
    * a row still pending when the next command comes ends there (before its start);
    * any other row ends at the earliest start among the later commands;
    * a command starts a new anchor chain if no earlier row runs until its issue time.
    """
    start = F.greatest(F.coalesce("effective_at", F.col("issued_at")), F.col("issued_at"))
    nothing = F.lit(None).cast("timestamp_ntz")
    existing = assignments.select("*", nothing.alias("issued_at"), F.lit(0).alias("is_command"))
    added = commands.select(
        "id",
        *SUBJECT,
        "plan_id",
        start.alias("assigned_at"),
        nothing.alias("period_anchor_at"),
        nothing.alias("unassigned_at"),
        F.col("issued_at").alias("updated_at"),
        "issued_at",
        F.lit(1).alias("is_command"),
    )
    order = ["is_command", F.coalesce("issued_at", "assigned_at"), "id"]
    history = Window.partitionBy(*SUBJECT).orderBy(*order)
    later = history.rowsBetween(1, Window.unboundedFollowing)
    earlier = history.rowsBetween(Window.unboundedPreceding, -1)

    is_command = F.col("is_command") == 1
    command_start = F.when(is_command, F.col("assigned_at"))
    rows = (
        existing.unionByName(added)
        .withColumn("next_issue", F.min(F.when(is_command, F.col("issued_at"))).over(later))
        .withColumn("next_start", F.min(command_start).over(later))
    )
    is_open = F.col("unassigned_at").isNull() | (F.col("unassigned_at") > F.col("next_issue"))
    pending = F.col("assigned_at") > F.col("next_issue")
    superseded = F.when(F.col("assigned_at") < F.col("next_start"), F.least("unassigned_at", "next_start"))
    new_end = (
        F.when(F.col("next_issue").isNull() | ~is_open, F.col("unassigned_at"))
        .when(pending, F.col("next_issue"))
        .otherwise(F.coalesce(superseded, F.col("unassigned_at")))
    )
    touched = ~new_end.eqNullSafe(F.col("unassigned_at"))
    rows = rows.withColumn("updated_at", F.when(touched, F.col("next_issue")).otherwise(F.col("updated_at")))
    rows = rows.withColumn("unassigned_at", new_end)

    runs = F.col("unassigned_at").isNull() | (F.col("unassigned_at") >= F.col("assigned_at"))
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    runs_until = F.when(runs, F.coalesce("unassigned_at", forever))
    rows = rows.withColumn("covered_until", F.max(runs_until).over(earlier))
    covered = F.coalesce(F.col("covered_until") >= F.col("issued_at"), F.lit(False))
    chain_anchor = F.when(~is_command, F.col("period_anchor_at")).when(~covered, truncated_to_second(F.col("assigned_at")))
    rows = rows.withColumn("chain_anchor", chain_anchor).withColumn("runs", runs)
    inherited = F.last(F.when(F.col("runs"), F.col("chain_anchor")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("period_anchor_at", F.coalesce("chain_anchor", inherited))
    return rows.select(*assignments.columns)


def unassign(assignments: DataFrame, subjects: DataFrame, now: str | datetime) -> DataFrame:
    """End every open or future assignment of the given subjects now."""
    at = ntz(now)
    gone = subjects.select(*SUBJECT).distinct().withColumn("gone", F.lit(True))
    ends = F.col("gone") & not_ended(at)
    rows = assignments.join(gone, SUBJECT, "left")
    return rows.select(
        *[c for c in assignments.columns if c not in ("unassigned_at", "updated_at")],
        F.when(ends, at).otherwise(F.col("unassigned_at")).alias("unassigned_at"),
        F.when(ends, at).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*assignments.columns)


# --- plans ---------------------------------------------------------------------------


def validate_plans(plans: DataFrame, limits: DataFrame, meters: DataFrame) -> DataFrame:
    """Rule breaks as `(workspace_id, plan_id, meter_name, period, message)`; empty when all is well."""
    key = ["workspace_id", "plan_id"]
    name = F.trim("name")
    no_text = F.lit(None).cast("string")
    named = plans.select("workspace_id", F.col("id").alias("plan_id"), name.alias("name"))
    name_error = F.when(F.coalesce("name", F.lit("")) == "", "plan name is required").when(
        F.char_length("name") > NAME_MAX_CHARS, f"plan name cannot exceed {NAME_MAX_CHARS} characters"
    )
    empty = named.join(limits.select(*key).distinct(), key, "left_anti").withColumn(
        "message", F.lit("at least one plan limit is required")
    )
    clean = normalize_limits(limits)
    repeated = (
        clean.groupBy(*key, "meter_name", "period")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("message", F.lit("duplicate limit for meter and period"))
    )
    known = meters.select("workspace_id", F.col("name").alias("meter_name"), F.lit(True).alias("known"))
    looked_up = clean.join(known, ["workspace_id", "meter_name"], "left")
    limit_value, warning = F.col("limit_value"), F.col("warning_percent")
    infinite = F.lit(float("inf"))
    limit_error = (
        F.when(F.coalesce("meter_name", F.lit("")) == "", "meter is required")
        .when(F.col("known").isNull(), "meter was not found")
        .when(~F.col("period").isin(*PERIODS), "unsupported plan period")
        .when(
            limit_value.isNull() | F.isnan(limit_value) | (limit_value <= 0) | (limit_value == infinite),
            "limit must be greater than zero",
        )
        .when(
            F.isnan(warning) | (warning <= 0) | (warning > 100),
            "warning percent must be greater than zero and at most 100",
        )
    )
    columns = [*key, "meter_name", "period", "message"]
    parts = [
        named.withColumn("message", name_error).select(*key, no_text.alias("meter_name"), no_text.alias("period"), "message"),
        empty.select(*key, no_text.alias("meter_name"), no_text.alias("period"), "message"),
        repeated.select(*columns),
        looked_up.withColumn("message", limit_error).select(*columns),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter(F.col("message").isNotNull())


def normalize_limits(limits: DataFrame) -> DataFrame:
    """Trimmed names, period default `month`, warning default 80."""
    period = F.lower(F.trim(F.coalesce("period", F.lit(""))))
    warning = F.coalesce("warning_percent", F.lit(0.0))
    return (
        limits.withColumn("meter_name", F.trim("meter_name"))
        .withColumn("period", F.when(period == "", "month").otherwise(period))
        .withColumn("warning_percent", F.when(warning == 0, WARNING_DEFAULT_PERCENT).otherwise(warning))
    )


def new_versions(
    plans: DataFrame,
    limits: DataFrame,
    assignments: DataFrame,
    updates: DataFrame,
    new_limits: DataFrame,
    now: str | datetime,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace current plans by a new version; returns (plans, limits, assignments).

    Updates: `workspace_id, plan_id, name, description`; `new_limits` carry the old
    plan id. The old version is retired and linked as parent. Every subject with a
    running assignment moves over now; one with only a pending assignment moves right
    after that one starts. Period anchors are kept.
    """
    at = ntz(now)
    key = ["workspace_id", "plan_id"]
    current = plans.filter("is_current").select(
        "workspace_id", F.col("id").alias("plan_id"), F.col("version").alias("old_version")
    )
    fresh = updates.join(current, key).withColumn(
        "new_id", F.sha2(F.concat_ws("|", *key, (F.col("old_version") + 1).cast("string")), 256)
    )
    new_plans = fresh.select(
        F.col("new_id").alias("id"),
        "workspace_id",
        F.trim("name").alias("name"),
        F.trim("description").alias("description"),
        (F.col("old_version") + 1).cast("int").alias("version"),
        F.col("plan_id").alias("parent_plan_id"),
        F.lit(True).alias("is_current"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    retired = fresh.select("workspace_id", F.col("plan_id").alias("id"), F.lit(True).alias("retired"))
    old_plans = plans.join(retired, ["workspace_id", "id"], "left").select(
        *[c for c in plans.columns if c not in ("is_current", "updated_at")],
        F.when(F.col("retired"), False).otherwise(F.col("is_current")).alias("is_current"),
        F.when(F.col("retired"), at).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*plans.columns)
    mapping = fresh.select(*key, "new_id")
    moved_limits = (
        normalize_limits(new_limits).join(mapping, key).withColumn("plan_id", F.col("new_id")).select(*limits.columns)
    )

    live = assignments.filter(not_ended(at)).join(mapping, key)
    per_subject = live.groupBy(*SUBJECT).agg(
        F.min_by("new_id", "assigned_at").alias("plan_id"), F.min("assigned_at").alias("starts")
    )
    just_after = F.col("starts") + F.expr("INTERVAL 0.000001 SECOND")
    moment = F.when(F.col("starts") < at, at).otherwise(just_after)
    commands = per_subject.select(
        F.sha2(F.concat_ws("|", *SUBJECT, "plan_id"), 256).alias("id"),
        *SUBJECT,
        "plan_id",
        moment.alias("effective_at"),
        moment.alias("issued_at"),
    )
    return (
        old_plans.unionByName(new_plans),
        limits.unionByName(moved_limits),
        assign(assignments, commands),
    )


# --- windows and counters -----------------------------------------------------------


def period_windows(assignments: DataFrame, until: str | datetime, periods: list[str] = PERIODS) -> DataFrame:
    """All period windows of each distinct anchor that start before `until`.

    The first window is emitted even if the anchor lies after `until`.
    """
    anchors = assignments.select(*SUBJECT, "period_anchor_at").distinct()
    return windows_until(anchors, ntz(until), periods)


def counter_partials(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """Counter partials for every (subject, meter) and all four periods.

    An event counts if an assignment is in effect at its time and it is not before the
    anchor. Week, month and year windows of an anchor consist of whole day windows,
    so the events are reduced per day window first and only those partials fan out to
    the four periods.
    """
    columns = ["id", *SUBJECT, "meter_name", "quantity", "event_time", "received_at"]
    anchor = F.col("period_anchor_at")
    placed = with_assignment(events.select(*columns), assignments)
    placed = placed.filter(F.col("event_time") >= anchor)
    daily = placed.groupBy(
        *SUBJECT, "meter_name", "period_anchor_at", day_index(F.col("event_time"), anchor).alias("day_index")
    ).agg(*partial_of_events())
    # A day's partial becomes four rows that are sorted. Without the anchor these are not the
    # columns that the aggregate is partitioned by already, else Spark would drop the step.
    daily = dealt_out(daily, *SUBJECT, "meter_name", "day_index")
    return merge_counters(_fan_out(daily))


def _fan_out(daily: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Day-window partials, once for each period window that holds the day window."""
    day_start = day_boundary(F.col("period_anchor_at"), F.col("day_index"))
    placed = with_windows(daily, day_start)
    windows = [F.struct(F.lit(p).alias("period"), F.col(f"{p}_window.*")) for p in PERIODS]
    return placed.select(*SUBJECT, "meter_name", *keep, F.inline(F.array(*windows)), *PARTIAL_COLUMNS)


def merge_counters(partials: DataFrame) -> DataFrame:
    """One counter per key from any number of partials."""
    return partials.groupBy(*COUNTER_KEY).agg(*merge_partials())


def flat_counters(counters: DataFrame) -> DataFrame:
    """Counters with first and last spread into plain columns."""
    return counters.select(
        *COUNTER_KEY,
        "event_count",
        "quantity_sum",
        "quantity_min",
        "quantity_max",
        F.col("first_event.quantity").alias("first_quantity"),
        F.col("first_event.event_time").alias("first_event_time"),
        F.col("last_event.quantity").alias("last_quantity"),
        F.col("last_event.event_time").alias("last_event_time"),
    )


# --- progress, checks, evaluation -----------------------------------------------------


def overage_state(current: Column, limit: Column, warning_percent: Column) -> Column:
    """At or above the limit: exceeded; else by percent of the limit."""
    return (
        F.when(current >= limit, EXCEEDED).when(percent_of(current, limit) >= warning_percent, WARNING).otherwise(OK)
    )


def percent_of(current: Column, limit: Column) -> Column:
    return F.when(limit > 0, current / limit * 100).otherwise(0.0)


def above_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _usage(rows: DataFrame, meters: DataFrame, counters: DataFrame, now: str | datetime) -> DataFrame:
    """Adds window, `current` and `event_count` to rows of subject, anchor, meter and period."""
    at = ntz(now)
    side = meters.select("workspace_id", F.col("name").alias("meter_name"), "aggregation", "unit")
    metered = rows.join(side, ["workspace_id", "meter_name"])
    placed = with_window_of(metered, at)
    # Windows that are over cannot match; dropping them first keeps the join small.
    live = counters.filter(F.col("period_end") > at)
    joined = placed.join(live, COUNTER_KEY, "left")
    seconds = seconds_between(F.col("period_start"), F.col("period_end"))
    return joined.withColumns(
        {
            "current": partial_value(F.col("aggregation"), seconds),
            "event_count": F.coalesce("event_count", F.lit(0)).cast("long"),
        }
    ).drop("quantity_sum", "quantity_min", "quantity_max", "first_event", "last_event")


def progress(
    assignments: DataFrame, limits: DataFrame, meters: DataFrame, counters: DataFrame, now: str | datetime
) -> DataFrame:
    """Usage against every limit of the plan each subject has now."""
    active = assignment_at(assignments, now).select(*SUBJECT, "plan_id", "period_anchor_at")
    rows = active.join(limits, ["workspace_id", "plan_id"])
    used = _usage(rows, meters, counters, now)
    current, limit = F.col("current"), F.col("limit_value")
    return used.select(
        *SUBJECT,
        "plan_id",
        "meter_name",
        "period",
        "period_start",
        "period_end",
        "aggregation",
        "unit",
        "current",
        "limit_value",
        above_zero(limit - current).alias("remaining"),
        above_zero(current - limit).alias("overage"),
        percent_of(current, limit).alias("percent"),
        "warning_percent",
        overage_state(current, limit, F.col("warning_percent")).alias("state"),
        "event_count",
    )


def first_limits(limits: DataFrame) -> DataFrame:
    """The one limit per (plan, meter) that checks use: the first period by name."""
    key = ["workspace_id", "plan_id", "meter_name"]
    rest = [c for c in limits.columns if c not in key]
    return (
        limits.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), "period").alias("pick"))
        .select(*key, "pick.*")
        .select(*limits.columns)
    )


def retry_after_seconds(now: Column, reset: Column) -> Column:
    return F.when(reset > now, F.ceil(seconds_between(now, reset))).otherwise(0).cast("long")


def check(
    requests: DataFrame,
    assignments: DataFrame,
    limits: DataFrame,
    meters: DataFrame,
    counters: DataFrame,
    now: str | datetime,
) -> DataFrame:
    """Answer quota requests `(request_id, workspace_id, subject, meter_name, quantity)`.

    Allowed while the projected value does not exceed the limit; reaching it exactly
    is allowed but already in state exceeded.
    """
    at = ntz(now)
    key = [*SUBJECT, "meter_name"]
    asked = F.coalesce("quantity", F.lit(0.0))
    requests = requests.withColumn("quantity", F.when(asked == 0, 1.0).otherwise(asked))
    plan_now = assignment_at(assignments, now).select(*SUBJECT, F.col("plan_id").alias("plan_now"))
    standing = progress(assignments, first_limits(limits), meters, counters, now).select(
        *key, "plan_id", "period", "period_start", "period_end", "current", "limit_value", "warning_percent"
    )
    # Written, because the size check and the join both read it.
    standing = materialize(standing, "standing")
    spread = F.xxhash64("request_id")
    rows = side_join(requests, plan_now, SUBJECT, "left", spread=spread, small=fits(assignments))
    rows = side_join(rows, standing, key, "left", spread=spread)
    projected, limit = F.col("current") + F.col("quantity"), F.col("limit_value")
    known = F.col("plan_id").isNotNull()
    allowed = F.coalesce(projected <= limit, F.lit(False))
    by_usage = overage_state(projected, limit, F.col("warning_percent"))
    state = (
        F.when(F.col("plan_now").isNull(), NO_PLAN)
        .when(~known, NOT_IN_PLAN)
        .when(~allowed, EXCEEDED)
        .otherwise(by_usage)
    )
    message = (
        F.when(F.col("plan_now").isNull(), "subject is not assigned to a plan")
        .when(~known, "meter is not included in the subject's plan")
        .when(~allowed, "quota would be exceeded")
        .when(by_usage == EXCEEDED, "quota is available; quota limit reached")
        .when(by_usage == WARNING, "quota is available; warning threshold reached")
        .otherwise("quota is available")
    )
    retry = F.when(known & ~allowed, retry_after_seconds(at, F.col("period_end"))).otherwise(0).cast("long")
    return rows.select(
        "request_id",
        *key,
        "quantity",
        F.col("plan_now").alias("plan_id"),
        "period",
        "period_start",
        "period_end",
        F.coalesce("current", F.lit(0.0)).alias("current"),
        F.coalesce("limit_value", F.lit(0.0)).alias("limit_value"),
        F.coalesce(above_zero(limit - projected), F.lit(0.0)).alias("remaining"),
        F.coalesce(above_zero(projected - limit), F.lit(0.0)).alias("overage"),
        allowed.alias("allowed"),
        state.alias("state"),
        retry.alias("retry_after_seconds"),
        message.alias("message"),
    )


def state_message(state: Column) -> Column:
    return (
        F.when(state == EXCEEDED, "quota exceeded")
        .when(state == WARNING, "quota warning threshold reached")
        .otherwise("quota is available")
    )


def transition_type(previous: Column, state: Column) -> Column:
    """warning / exceeded on entering, recovered on returning to ok; NULL when unchanged."""
    changed = ~previous.eqNullSafe(state)
    return F.when(
        changed,
        F.when(state == OK, F.when(previous.isNotNull(), "recovered"))
        .when(state == WARNING, "warning")
        .when(state == EXCEEDED, "exceeded"),
    )


STATE_KEY = [*SUBJECT, "meter_name", "plan_id", "period"]


def evaluate(
    keys: DataFrame,
    assignments: DataFrame,
    limits: DataFrame,
    meters: DataFrame,
    counters: DataFrame,
    previous: DataFrame,
    now: str | datetime,
) -> DataFrame:
    """Evaluate affected `(workspace, subject, meter)` keys against the previous states.

    One row per key with a plan limit: the new state, the period snapshot values, and
    `event_type` (NULL when nothing changed). `previous` has `STATE_KEY` and `state`.
    """
    standing = progress(assignments, first_limits(limits), meters, counters, now)
    rows = standing.join(keys.select(*SUBJECT, "meter_name").distinct(), [*SUBJECT, "meter_name"], "left_semi")
    before = previous.select(*STATE_KEY, F.col("state").alias("previous_state"))
    joined = rows.join(before, STATE_KEY, "left")
    return joined.select(
        *joined.columns,
        state_message(F.col("state")).alias("message"),
        transition_type(F.col("previous_state"), F.col("state")).alias("event_type"),
        ntz(now).alias("evaluated_at"),
    )


def closed_windows(
    changed: DataFrame, counters: DataFrame, assignments: DataFrame, limits: DataFrame, meters: DataFrame
) -> DataFrame:
    """Snapshots of some windows that are over, under the plan in effect when they ended.

    `changed` holds the windows (`COUNTER_KEY`); only their counter partials are merged. A window
    whose subject had no plan at its end, or none with a limit for it, has no snapshot.
    """
    merged = merge_counters(counters.join(changed, COUNTER_KEY, "left_semi"))
    last_moment = F.col("period_end") - F.expr("INTERVAL '0.000001' SECOND")
    rows = merged.withColumns({"event_time": last_moment, "id": F.xxhash64(*COUNTER_KEY)})
    rows = with_assignment(rows, assignments).drop("event_time", "id", "period_anchor_at")
    limit_key = ["workspace_id", "plan_id", "meter_name", "period"]
    rows = rows.join(first_limits(limits).select(*limit_key, "limit_value", "warning_percent"), limit_key)
    side = meters.select("workspace_id", F.col("name").alias("meter_name"), "aggregation")
    rows = rows.join(side, ["workspace_id", "meter_name"])
    seconds = seconds_between(F.col("period_start"), F.col("period_end"))
    rows = rows.withColumn("current", partial_value(F.col("aggregation"), seconds))
    current, limit = F.col("current"), F.col("limit_value")
    state = overage_state(current, limit, F.col("warning_percent"))
    return snapshots(rows.withColumns({"remaining": above_zero(limit - current), "state": state}))


def states(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(
        *STATE_KEY, "state", "current", "limit_value", "remaining", "warning_percent", "message", "evaluated_at"
    )


def events_of(evaluated: DataFrame) -> DataFrame:
    """Transition events; the id hashes the key and time, so a retry repeats it."""
    identity = F.concat_ws("|", *STATE_KEY, F.col("evaluated_at").cast("string"))
    return evaluated.filter(F.col("event_type").isNotNull()).select(
        F.sha2(identity, 256).alias("id"),
        *STATE_KEY,
        "previous_state",
        "state",
        F.col("event_type").alias("type"),
        "current",
        "limit_value",
        "remaining",
        "warning_percent",
        "message",
        F.col("evaluated_at").alias("created_at"),
    )


def snapshots(progress_rows: DataFrame, *extra: Column) -> DataFrame:
    """Period snapshot values: what the plan includes, and the overage beyond it."""
    current, limit = F.col("current"), F.col("limit_value")
    return progress_rows.select(
        *STATE_KEY,
        "period_start",
        "period_end",
        "state",
        "current",
        "limit_value",
        above_zero(F.least(current, limit)).alias("included"),
        above_zero(current - limit).alias("overage"),
        "remaining",
        "warning_percent",
        "event_count",
        *extra,
    )


def replay_transitions(
    events: DataFrame,
    assignments: DataFrame,
    limits: DataFrame,
    meters: DataFrame,
    step_hours: int = 1,
) -> DataFrame:
    """Quota transitions a history of events would have caused, evaluated every step.

    Each subject's usage is evaluated at the end of every step that has events, in the
    period window of the events and against the plan of that time. Events reduce to one
    partial per (subject, meter, day window, step) before the running value is taken, so
    a window function never sees single events: its rows per key are bounded by the
    steps of one period.
    """
    placed = with_assignment(
        events.select("id", *SUBJECT, "meter_name", "quantity", "event_time", "received_at"),
        assignments,
        keep_start=True,
    ).filter(F.col("event_time") >= F.col("period_anchor_at"))
    anchor, time = F.col("period_anchor_at"), F.col("event_time")
    hours = (F.floor(F.hour(time) / step_hours) + 1).cast("int") * step_hours
    tick = F.to_date(time).cast("timestamp_ntz") + F.make_dt_interval(hours=hours)
    steps = placed.groupBy(
        *SUBJECT,
        "meter_name",
        "plan_id",
        "valid_from",
        "period_anchor_at",
        day_index(time, anchor).alias("day_index"),
        tick.alias("tick"),
    ).agg(*partial_of_events())

    # Usage accumulates over plan changes, so the plan is not part of the running key.
    usage_key = [*SUBJECT, "meter_name", "period", "period_start", "period_end"]
    fanned = _fan_out(steps, ["plan_id", "valid_from", "tick", "day_index"])
    running = (
        Window.partitionBy(*usage_key)
        .orderBy("tick", "day_index", "valid_from")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = fanned.select(
        *usage_key, "plan_id", "tick", "day_index", "valid_from", *[c.over(running).alias(n) for n, c in _running()]
    )
    wanted = first_limits(limits).select(*["workspace_id", "plan_id", "meter_name", "period"], "limit_value", "warning_percent")
    rows = side_join(
        totals, wanted, ["workspace_id", "plan_id", "meter_name", "period"], spread=F.xxhash64("subject", "tick")
    )
    side = meters.select("workspace_id", F.col("name").alias("meter_name"), "aggregation")
    rows = side_join(rows, side, ["workspace_id", "meter_name"], spread=F.xxhash64("subject", "tick"))
    seconds = seconds_between(F.col("period_start"), F.col("period_end"))
    valued = rows.withColumn("current", partial_value(F.col("aggregation"), seconds))
    valued = valued.withColumn("state", overage_state(F.col("current"), F.col("limit_value"), F.col("warning_percent")))
    in_order = Window.partitionBy(*STATE_KEY).orderBy("tick", "day_index", "valid_from")
    seen = valued.withColumn("previous_state", F.lag("state").over(in_order))
    changes = seen.withColumn("type", transition_type(F.col("previous_state"), F.col("state")))
    return changes.filter(F.col("type").isNotNull()).select(
        *STATE_KEY, "period_start", "tick", "previous_state", "state", "type", "current", "limit_value"
    )


def _running() -> list[tuple[str, Column]]:
    return [
        ("event_count", F.sum("event_count")),
        ("quantity_sum", F.sum("quantity_sum")),
        ("quantity_min", F.min("quantity_min")),
        ("quantity_max", F.max("quantity_max")),
        ("first_event", F.min("first_event")),
        ("last_event", F.max("last_event")),
    ]


# --- preview --------------------------------------------------------------------------


def preview(
    assignments: DataFrame,
    current_limits: DataFrame,
    proposed_limits: DataFrame,
    meters: DataFrame,
    counters: DataFrame,
    now: str | datetime,
) -> DataFrame:
    """Every assigned subject's limits before and after a plan change, one row per limit.

    Both limit tables carry `workspace_id, plan_id` of the current plan. A new limit
    has current state `not_in_plan`, a removed one has that as its proposed state.
    """
    at = ntz(now)
    key = ["workspace_id", "plan_id", "meter_name", "period"]
    proposed_limits = normalize_limits(proposed_limits)
    old = current_limits.select(
        *key, F.col("limit_value").alias("current_limit"), F.col("warning_percent").alias("current_warning")
    )
    new = proposed_limits.select(
        *key, F.col("limit_value").alias("proposed_limit"), F.col("warning_percent").alias("proposed_warning")
    )
    both = old.join(new, key, "full_outer")
    plans = proposed_limits.select("workspace_id", "plan_id").distinct()
    subjects = assignments.filter(not_ended(at)).select(*SUBJECT, "plan_id", "period_anchor_at")
    subjects = subjects.join(plans, ["workspace_id", "plan_id"], "left_semi")
    rows = subjects.join(both, ["workspace_id", "plan_id"])
    used = _usage(rows, meters, counters, now)
    current = F.col("current")

    def state(limit: str, warning: str) -> Column:
        return F.when(F.col(limit).isNull(), NOT_IN_PLAN).otherwise(
            overage_state(current, F.col(limit), F.col(warning))
        )

    return used.select(
        *SUBJECT,
        "plan_id",
        "meter_name",
        "period",
        "current",
        "current_limit",
        "proposed_limit",
        state("current_limit", "current_warning").alias("current_state"),
        state("proposed_limit", "proposed_warning").alias("proposed_state"),
        F.col("proposed_limit").isNull().alias("removed"),
    )


def preview_subjects(items: DataFrame) -> DataFrame:
    """Per subject: the worst proposed state and the number of removed limits."""
    severity = F.when(F.col("proposed_state") == EXCEEDED, 2).when(F.col("proposed_state") == WARNING, 1).otherwise(0)
    worst = items.groupBy(*SUBJECT, "plan_id").agg(
        F.max(severity).alias("severity"), F.count_if("removed").alias("removed_limits")
    )
    name = F.when(F.col("severity") == 2, EXCEEDED).when(F.col("severity") == 1, WARNING).otherwise(OK)
    return worst.select(*SUBJECT, "plan_id", name.alias("worst_state"), "removed_limits")


def preview_summary(items: DataFrame) -> DataFrame:
    """Per plan: subjects, and how many end up ok, warning or exceeded; removed limits."""
    state = F.col("worst_state")
    return preview_subjects(items).groupBy("workspace_id", "plan_id").agg(
        F.count(F.lit(1)).alias("subjects"),
        F.count_if(state == OK).alias("ok"),
        F.count_if(state == WARNING).alias("warning"),
        F.count_if(state == EXCEEDED).alias("exceeded"),
        F.sum("removed_limits").alias("removed_limits"),
    )


# --- lists -----------------------------------------------------------------------------


def list_rows(rows: DataFrame, order: list[tuple[str, bool]], limit: int, **equals) -> DataFrame:
    """Rows matching all set arguments, ordered by (column, ascending), cut to `limit`."""
    for name, value in equals.items():
        if value not in (None, ""):
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(limit)


def list_assignments(
    assignments: DataFrame,
    plans: DataFrame,
    now: str | datetime,
    include_history: bool = False,
    subject: str | None = None,
    plan_id: str | None = None,
) -> DataFrame:
    """Assignments with plan name and version and their status; open ones only by default."""
    rows = assignments if include_history else assignments.filter(not_ended(ntz(now)))
    for column, value in (("subject", subject), ("plan_id", plan_id)):
        if value:
            rows = rows.filter(F.col(column) == value)
    side = plans.select(
        "workspace_id",
        F.col("id").alias("plan_id"),
        F.col("name").alias("plan_name"),
        F.col("version").alias("plan_version"),
    )
    return rows.join(side, ["workspace_id", "plan_id"]).withColumn("status", assignment_status(now))
