"""Registered quota queries: assignments, windows, counters, progress, checks, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz
from meterframe.operators import entitlements as ent
from meterframe.plans.registry import EV, MET, ORD, ctes, query, rounded
from meterframe.schema import PLAN, PLAN_LIMIT
from meterframe.session import materialize, scratch_path
from meterframe.sources.store import EventStore
from meterframe.sources.tables import (
    event_meters,
    raw_from_usage,
    table,
    usage_from_events,
    usage_from_orders,
    workspace_of,
)

NOW = "2024-01-25T12:00:00Z"
BEFORE = "2024-01-24T12:00:00Z"
LATER = "2024-01-27T09:30:00Z"
SQL_NOW = "TIMESTAMP '2024-01-25 12:00:00'"

# Fixed plan catalogue of the checks: meter, period, base limit, warning percent.
# A plan multiplies the base limits; `free` leaves out `signup`.
PLAN_FACTOR = {"free": 1.0, "pro": 2.0, "scale": 4.0}
BASE_LIMITS = [
    ("purchase", "month", 900.0, 50.0),
    ("purchase", "week", 150.0, 80.0),
    ("click", "day", 1.0, 80.0),
    ("view", "week", 90.0, 60.0),
    ("signup", "month", 60.0, 90.0),
    ("error", "year", 40.0, 30.0),
]
WORKSPACES = ["ws_0", "ws_1", "ws_2"]


def _limit_rows(factor: float = 1.0) -> list[tuple]:
    return [
        (workspace, plan, meter, period, base * plan_factor * factor, warning)
        for workspace in WORKSPACES
        for plan, plan_factor in PLAN_FACTOR.items()
        for meter, period, base, warning in BASE_LIMITS
        if not (plan == "free" and meter == "signup")
    ]


def _proposed_rows() -> list[tuple]:
    """A change of every plan: half the limits, no `view`, and new yearly clicks."""
    rows = [row for row in _limit_rows(0.5) if row[2] != "view"]
    new = [(w, p, "click", "year", 20.0 * f, 0.0) for w in WORKSPACES for p, f in PLAN_FACTOR.items()]
    return rows + new


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


def _limits_sql(name: str, rows: list[tuple]) -> str:
    return f"""{name}(workspace_id, plan_id, meter_name, period, limit_value, warning_percent) AS (
  SELECT a, b, c, d, CAST(e AS DOUBLE), CAST(f AS DOUBLE) FROM (VALUES {_values(rows)}) t(a, b, c, d, e, f))"""


def limits(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else _limit_rows(), PLAN_LIMIT)


def plans(spark: SparkSession) -> DataFrame:
    rows = [
        (plan, workspace, plan.title(), "", 1, None, True, None, None)
        for workspace in WORKSPACES
        for plan in PLAN_FACTOR
    ]
    created = ntz("2024-01-01T00:00:00Z")
    return spark.createDataFrame(rows, PLAN).withColumns({"created_at": created, "updated_at": created})


# Each user of the event table gets an assignment; some move to the next plan after 12
# days, some are ended then.


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """The assignment history, written once as the table it stands for."""
    return materialize(derived_assignments(spark, folder), "assignments")


def derived_assignments(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select(F.col("user_id").alias("u")).distinct()
    u = F.col("u")
    started = ntz("2024-01-01T00:00:00Z") + F.make_dt_interval(days=u % 7, hours=u % 24)
    after = started + F.make_dt_interval(days=F.lit(12))

    def plan(number):
        return F.element_at(F.array(*[F.lit(p) for p in PLAN_FACTOR]), (number % 3 + 1).cast("int"))

    moves, ends = u % 4 == 0, u % 4 == 1
    common = [workspace_of(u).alias("workspace_id"), F.concat(F.lit("user_"), u.cast("string")).alias("subject")]
    first = users.select(
        F.concat(F.lit("a1-"), u.cast("string")).alias("id"),
        *common,
        plan(F.floor(u / 3)).alias("plan_id"),
        started.alias("assigned_at"),
        started.alias("period_anchor_at"),
        F.when(moves | ends, after).alias("unassigned_at"),
        F.when(moves | ends, after).otherwise(started).alias("updated_at"),
    )
    second = users.filter(moves).select(
        F.concat(F.lit("a2-"), u.cast("string")).alias("id"),
        *common,
        plan(F.floor(u / 3) + 1).alias("plan_id"),
        after.alias("assigned_at"),
        started.alias("period_anchor_at"),
        F.lit(None).cast("timestamp_ntz").alias("unassigned_at"),
        after.alias("updated_at"),
    )
    return first.unionByName(second)


ASG = """usr AS (SELECT DISTINCT user_id AS u FROM events),
st AS (SELECT u, 'ws_' || CAST(u % 3 AS VARCHAR) AS workspace_id, 'user_' || CAST(u AS VARCHAR) AS subject,
  TIMESTAMP '2024-01-01' + to_days(CAST(u % 7 AS INTEGER)) + to_hours(CAST(u % 24 AS INTEGER)) AS started FROM usr),
asg AS (
  SELECT 'a1-' || CAST(u AS VARCHAR) AS id, workspace_id, subject,
    ['free', 'pro', 'scale'][CAST((u // 3) % 3 + 1 AS INTEGER)] AS plan_id, started AS assigned_at,
    started AS period_anchor_at, CASE WHEN u % 4 IN (0, 1) THEN started + INTERVAL 12 DAY END AS unassigned_at,
    CASE WHEN u % 4 IN (0, 1) THEN started + INTERVAL 12 DAY ELSE started END AS updated_at FROM st
  UNION ALL
  SELECT 'a2-' || CAST(u AS VARCHAR), workspace_id, subject,
    ['free', 'pro', 'scale'][CAST((u // 3 + 1) % 3 + 1 AS INTEGER)], started + INTERVAL 12 DAY, started,
    CAST(NULL AS TIMESTAMP), started + INTERVAL 12 DAY FROM st WHERE u % 4 = 0)"""

# Windows by stepping from each anchor; all anchors lie on day 1 to 7.
WIN = """win AS (
  SELECT DISTINCT workspace_id, subject, period, s AS period_start,
    CASE period WHEN 'day' THEN s + INTERVAL 1 DAY WHEN 'week' THEN s + INTERVAL 7 DAY
      WHEN 'month' THEN s + INTERVAL 1 MONTH ELSE s + INTERVAL 1 YEAR END AS period_end
  FROM (SELECT workspace_id, subject, period, period_anchor_at + CASE period WHEN 'day' THEN to_days(CAST(n AS INTEGER))
          WHEN 'week' THEN to_days(CAST(7 * n AS INTEGER)) WHEN 'month' THEN to_months(CAST(n AS INTEGER))
          ELSE to_years(CAST(n AS INTEGER)) END AS s
        FROM asg, (VALUES ('day'), ('week'), ('month'), ('year')) p(period), range(0, 40) r(n))
  WHERE s < TIMESTAMP '2024-02-10' OR period IN ('month', 'year'))"""

CNT = """placed AS (
  SELECT e.*, a.plan_id, a.period_anchor_at FROM ev e JOIN asg a
    ON a.workspace_id = e.workspace_id AND a.subject = e.subject AND a.assigned_at <= e.event_time
   AND (a.unassigned_at IS NULL OR a.unassigned_at > e.event_time) AND e.event_time >= a.period_anchor_at),
cnt AS (
  SELECT e.workspace_id, e.subject, e.meter_name, w.period, w.period_start, w.period_end, count(*) AS event_count,
    sum(quantity) AS quantity_sum, min(quantity) AS quantity_min, max(quantity) AS quantity_max,
    first(quantity ORDER BY event_time, received_at, id) AS first_quantity, min(event_time) AS first_event_time,
    first(quantity ORDER BY event_time DESC, received_at DESC, id DESC) AS last_quantity,
    max(event_time) AS last_event_time
  FROM placed e JOIN win w ON w.workspace_id = e.workspace_id AND w.subject = e.subject
   AND e.event_time >= w.period_start AND e.event_time < w.period_end
  GROUP BY 1, 2, 3, 4, 5, 6)"""

VALUE = """CASE WHEN coalesce(c.event_count, 0) = 0 THEN 0.0 ELSE CASE m.aggregation
    WHEN 'count' THEN CAST(c.event_count AS DOUBLE) WHEN 'max' THEN c.quantity_max WHEN 'last' THEN c.last_quantity
    ELSE c.quantity_sum END END"""


def _state(current: str, limit: str, warning: str) -> str:
    return (
        f"CASE WHEN {current} >= {limit} THEN 'exceeded' WHEN {current} / {limit} * 100 >= {warning} "
        "THEN 'warning' ELSE 'ok' END"
    )


def _progress_sql(name: str, limit_table: str, now: str) -> str:
    return f"""{name} AS (
  SELECT a.workspace_id, a.subject, a.plan_id, l.meter_name, l.period, w.period_start, w.period_end, m.aggregation,
    'unit' AS unit, {VALUE} AS current, l.limit_value, l.warning_percent,
    CAST(coalesce(c.event_count, 0) AS BIGINT) AS event_count
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, subject ORDER BY assigned_at DESC) AS rn FROM asg
        WHERE assigned_at <= {now} AND (unassigned_at IS NULL OR unassigned_at > {now})) a
  JOIN {limit_table} l ON l.workspace_id = a.workspace_id AND l.plan_id = a.plan_id
  JOIN met m ON m.workspace_id = a.workspace_id AND m.name = l.meter_name
  JOIN win w ON w.workspace_id = a.workspace_id AND w.subject = a.subject AND w.period = l.period
    AND w.period_start <= {now} AND w.period_end > {now}
  LEFT JOIN cnt c ON c.workspace_id = a.workspace_id AND c.subject = a.subject AND c.meter_name = l.meter_name
    AND c.period = l.period AND c.period_start = w.period_start
  WHERE a.rn = 1)"""


FIRST = """fst AS (SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, plan_id, meter_name ORDER BY period) AS rn FROM lim) WHERE rn = 1)"""

BASE = [EV, MET, ASG, WIN, CNT, _limits_sql("lim", _limit_rows()), FIRST]


class _Tables:
    """The inputs that the quota queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.usage = usage_from_events(spark, folder)
        self.meters = event_meters(spark, folder)
        self.assignments = assignments(spark, folder)
        self.limits = limits(spark)
        self.counters = ent.counter_partials(self.usage, self.assignments)


# --- assignments ------------------------------------------------------------------------


@query(
    "assignment_asof",
    ctes(EV, ASG)
    + """SELECT e.id, e.subject, e.event_time, a.plan_id, a.period_anchor_at FROM ev e LEFT JOIN asg a
  ON a.workspace_id = e.workspace_id AND a.subject = e.subject AND a.assigned_at <= e.event_time
 AND (a.unassigned_at IS NULL OR a.unassigned_at > e.event_time)""",
)
def assignment_asof(spark, folder):
    joined = ent.with_assignment(usage_from_events(spark, folder), assignments(spark, folder), "left")
    return joined.select("id", "subject", "event_time", "plan_id", "period_anchor_at")


@query(
    "assignment_asof_overlap",
    ctes(EV, ASG)
    + """, asg2 AS (SELECT workspace_id, subject, plan_id, assigned_at, unassigned_at FROM asg UNION ALL
  SELECT workspace_id, subject, 'promo', started + INTERVAL 2 DAY, started + INTERVAL 4 DAY FROM st WHERE u % 3 = 0)
SELECT id, plan_id FROM (SELECT e.id, a.plan_id, row_number() OVER (PARTITION BY e.id ORDER BY a.assigned_at DESC) AS rn
  FROM ev e LEFT JOIN asg2 a ON a.workspace_id = e.workspace_id AND a.subject = e.subject
   AND a.assigned_at <= e.event_time AND (a.unassigned_at IS NULL OR a.unassigned_at > e.event_time)) WHERE rn = 1""",
)
def assignment_asof_overlap(spark, folder):
    """Some subjects have a two-day plan on top of their running one, which then comes back."""
    history = assignments(spark, folder)
    number = F.regexp_extract("subject", r"(\d+)$", 1).cast("long")
    start = F.col("assigned_at") + F.expr("INTERVAL 2 DAY")
    promo = history.filter(F.col("id").startswith("a1-") & (number % 3 == 0)).withColumns(
        {
            "id": F.concat(F.lit("p"), "id"),
            "plan_id": F.lit("promo"),
            "assigned_at": start,
            "unassigned_at": F.col("assigned_at") + F.expr("INTERVAL 4 DAY"),
            "updated_at": start,
        }
    )
    joined = ent.with_assignment(usage_from_events(spark, folder), history.unionByName(promo), "left")
    return joined.select("id", "plan_id")


@query(
    "assignment_at",
    ctes(ASG)
    + f"""SELECT id, workspace_id, subject, plan_id FROM asg
WHERE assigned_at <= {SQL_NOW} AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW})""",
)
def assignment_at(spark, folder):
    return ent.assignment_at(assignments(spark, folder), NOW).select("id", "workspace_id", "subject", "plan_id")


@query(
    "assignment_list",
    ctes(ASG)
    + """SELECT id, subject, plan_id, upper(plan_id[1]) || plan_id[2:] AS plan_name, CAST(1 AS INTEGER) AS plan_version,
  CASE WHEN assigned_at > TIMESTAMP '2024-01-10' THEN 'scheduled'
       WHEN unassigned_at IS NULL OR unassigned_at > TIMESTAMP '2024-01-10' THEN 'active' ELSE 'ended' END AS status
FROM asg""",
)
def assignment_list(spark, folder):
    rows = ent.list_assignments(
        assignments(spark, folder), plans(spark), "2024-01-10T00:00:00Z", include_history=True
    )
    return rows.select("id", "subject", "plan_id", "plan_name", "plan_version", "status")


@query(
    "unassign",
    ctes(ASG)
    + f"""SELECT id, CASE WHEN plan_id = 'pro' AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW}) THEN {SQL_NOW}
  ELSE unassigned_at END AS unassigned_at
FROM (SELECT a.* REPLACE (CASE WHEN p.subject IS NULL THEN '-' ELSE 'pro' END AS plan_id) FROM asg a
      LEFT JOIN (SELECT DISTINCT workspace_id, subject FROM asg WHERE plan_id = 'pro') p
        ON p.workspace_id = a.workspace_id AND p.subject = a.subject)""",
)
def unassign(spark, folder):
    rows = assignments(spark, folder)
    return ent.unassign(rows, rows.filter("plan_id = 'pro'"), NOW).select("id", "unassigned_at")


def _commands(spark, folder) -> DataFrame:
    """Two commands per user who has purchases: a move at once and a scheduled one later."""
    per_user = (
        usage_from_events(spark, folder)
        .filter("meter_name = 'purchase'")
        .groupBy("workspace_id", "subject")
        .agg(F.min("event_time").alias("issued_at"))
    )
    late = ntz("2024-02-05T00:00:00Z")
    now = per_user.select(
        F.concat(F.lit("c1-"), "subject").alias("id"),
        "workspace_id",
        "subject",
        F.lit("scale").alias("plan_id"),
        F.lit(None).cast("timestamp_ntz").alias("effective_at"),
        "issued_at",
    )
    scheduled = per_user.select(
        F.concat(F.lit("c2-"), "subject").alias("id"),
        "workspace_id",
        "subject",
        F.lit("free").alias("plan_id"),
        late.alias("effective_at"),
        F.greatest(F.col("issued_at") + F.expr("INTERVAL 2 DAYS"), ntz("2024-01-20T00:00:00Z")).alias("issued_at"),
    )
    return now.unionByName(scheduled)


@query(
    "scd2_assign",
    ctes(
        EV,
        ASG,
        """cmd AS (SELECT workspace_id, subject, min(event_time) AS t1,
  greatest(min(event_time) + INTERVAL 2 DAY, TIMESTAMP '2024-01-20') AS t2
  FROM ev WHERE meter_name = 'purchase' GROUP BY 1, 2)""",
        # The row that runs when the first command is issued.
        """run AS (SELECT c.workspace_id, c.subject, max(a.period_anchor_at) AS anchor FROM cmd c JOIN asg a
  ON a.workspace_id = c.workspace_id AND a.subject = c.subject AND a.assigned_at <= c.t1
 AND (a.unassigned_at IS NULL OR a.unassigned_at > c.t1) GROUP BY 1, 2)""",
    )
    + """SELECT a.id, a.plan_id, a.assigned_at, a.period_anchor_at,
  CASE WHEN c.subject IS NULL THEN a.unassigned_at
       WHEN a.assigned_at > c.t1 THEN CASE WHEN a.unassigned_at IS NULL OR a.unassigned_at > c.t1 THEN c.t1
                                           ELSE a.unassigned_at END
       WHEN a.assigned_at < c.t1 AND (a.unassigned_at IS NULL OR a.unassigned_at > c.t1) THEN c.t1
       ELSE a.unassigned_at END AS unassigned_at
FROM asg a LEFT JOIN cmd c ON c.workspace_id = a.workspace_id AND c.subject = a.subject
UNION ALL
SELECT 'c1-' || c.subject, 'scale', c.t1, coalesce(r.anchor, date_trunc('second', c.t1)::TIMESTAMP), TIMESTAMP '2024-02-05'
FROM cmd c LEFT JOIN run r USING (workspace_id, subject)
UNION ALL
SELECT 'c2-' || c.subject, 'free', TIMESTAMP '2024-02-05', coalesce(r.anchor, date_trunc('second', c.t1)::TIMESTAMP), NULL
FROM cmd c LEFT JOIN run r USING (workspace_id, subject)""",
)
def scd2_assign(spark, folder):
    rows = ent.assign(assignments(spark, folder), _commands(spark, folder))
    return rows.select("id", "plan_id", "assigned_at", "period_anchor_at", "unassigned_at")


@query(
    "plan_new_version",
    ctes(ASG)
    + f"""SELECT subject, CASE WHEN plan_id = 'pro' THEN 'pro' ELSE plan_id END AS old_plan, assigned_at, period_anchor_at,
  CASE WHEN plan_id = 'pro' AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW}) THEN {SQL_NOW} ELSE unassigned_at END
    AS unassigned_at FROM asg
UNION ALL
SELECT subject, 'pro v2', {SQL_NOW}, period_anchor_at, NULL FROM asg
WHERE plan_id = 'pro' AND assigned_at < {SQL_NOW} AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW})""",
)
def plan_new_version(spark, folder):
    rows = assignments(spark, folder)
    updates = plans(spark).filter("id = 'pro'").select("workspace_id", F.col("id").alias("plan_id"), "name", "description")
    new_limits = limits(spark).filter("plan_id = 'pro'")
    new_plans, _, moved = ent.new_versions(plans(spark), limits(spark), rows, updates, new_limits, NOW)
    names = new_plans.select(
        F.col("id").alias("plan_id"),
        "workspace_id",
        F.when(F.col("version") == 2, F.concat("parent_plan_id", F.lit(" v2"))).otherwise(F.col("id")).alias("old_plan"),
    )
    joined = moved.join(names, ["workspace_id", "plan_id"])
    return joined.select("subject", "old_plan", "assigned_at", "period_anchor_at", "unassigned_at")


# --- windows and counters ------------------------------------------------------------------


def _customer_anchors(spark, folder) -> DataFrame:
    """Customers as subjects anchored on days 29 to 31, where calendar addition overflows."""
    c = F.col("c_custkey")
    anchor = ntz("1995-01-29T15:30:00Z") + F.make_dt_interval(days=c % 3, hours=c % 8)
    return table(spark, folder, "customer").select(
        F.concat(F.lit("a-"), c.cast("string")).alias("id"),
        workspace_of(c).alias("workspace_id"),
        F.concat(F.lit("c"), c.cast("string")).alias("subject"),
        F.lit("pro").alias("plan_id"),
        anchor.alias("assigned_at"),
        anchor.alias("period_anchor_at"),
        F.lit(None).cast("timestamp_ntz").alias("unassigned_at"),
        anchor.alias("updated_at"),
    )


# Stepwise addition with overflow: the month after `s` is its first day plus one month
# plus the distance of `s` from its own first day.
CHAIN = """cust AS (SELECT 'ws_' || CAST(c_custkey % 3 AS VARCHAR) AS workspace_id, 'c' || CAST(c_custkey AS VARCHAR) AS subject,
  TIMESTAMP '1995-01-29 15:30:00' + to_days(CAST(c_custkey % 3 AS INTEGER)) + to_hours(CAST(c_custkey % 8 AS INTEGER)) AS anchor
  FROM customer),
step(anchor, period, s) AS (
  SELECT DISTINCT anchor, p.period, anchor FROM cust, (VALUES ('day'), ('week'), ('month'), ('year')) p(period)
  UNION ALL
  SELECT anchor, period, CASE period WHEN 'day' THEN s + INTERVAL 1 DAY WHEN 'week' THEN s + INTERVAL 7 DAY
    WHEN 'month' THEN date_trunc('month', s)::TIMESTAMP + INTERVAL 1 MONTH + (s - date_trunc('month', s)::TIMESTAMP)
    ELSE date_trunc('month', s)::TIMESTAMP + INTERVAL 1 YEAR + (s - date_trunc('month', s)::TIMESTAMP) END
  FROM step WHERE s < TIMESTAMP '2001-09-01'),
cwin AS (SELECT c.workspace_id, c.subject, s.period, s.s AS period_start,
  lead(s.s) OVER (PARTITION BY c.subject, s.period ORDER BY s.s) AS period_end
  FROM cust c JOIN step s ON s.anchor = c.anchor)"""


@query(
    "period_windows",
    ctes(CHAIN)
    + """SELECT workspace_id, subject, period, period_start, period_end FROM cwin
WHERE period IN ('month', 'year') AND period_start < TIMESTAMP '2001-08-01'""",
)
def period_windows(spark, folder):
    rows = ent.period_windows(_customer_anchors(spark, folder), "2001-08-01T00:00:00Z", ["month", "year"])
    return rows.select("workspace_id", "subject", "period", "period_start", "period_end")


@query(
    "usage_counters",
    ctes(EV, ASG, WIN, CNT)
    + """SELECT workspace_id, subject, meter_name, period, period_start, period_end, event_count,
  round(quantity_sum, 6) AS quantity_sum, quantity_min, quantity_max, first_quantity, first_event_time, last_quantity,
  last_event_time FROM cnt""",
)
def usage_counters(spark, folder):
    rows = ent.counter_partials(usage_from_events(spark, folder), assignments(spark, folder))
    return rounded(ent.flat_counters(rows), "quantity_sum")


@query(
    "usage_counters_years",
    ctes(ORD, CHAIN)
    + """SELECT o.workspace_id, o.subject, o.meter_name, w.period, w.period_start, w.period_end,
  count(*) AS event_count, round(sum(quantity), 4) AS quantity_sum, min(quantity) AS quantity_min,
  max(quantity) AS quantity_max, first(quantity ORDER BY event_time, received_at, id) AS first_quantity,
  min(event_time) AS first_event_time,
  first(quantity ORDER BY event_time DESC, received_at DESC, id DESC) AS last_quantity, max(event_time) AS last_event_time
FROM ord o JOIN cust c ON c.subject = o.subject AND o.event_time >= c.anchor
JOIN cwin w ON w.subject = o.subject AND o.event_time >= w.period_start AND o.event_time < w.period_end
GROUP BY 1, 2, 3, 4, 5, 6""",
)
def usage_counters_years(spark, folder):
    rows = ent.counter_partials(usage_from_orders(spark, folder), _customer_anchors(spark, folder))
    return rounded(ent.flat_counters(rows), "quantity_sum", digits=4)


@query(
    "usage_counters_merged",
    ctes(EV, ASG, WIN, CNT)
    + """SELECT workspace_id, subject, meter_name, period, period_start, period_end, event_count,
  round(quantity_sum, 6) AS quantity_sum, quantity_min, quantity_max, first_quantity, first_event_time, last_quantity,
  last_event_time FROM cnt""",
)
def usage_counters_merged(spark, folder):
    """Partials of two halves of the history, merged: equal to one pass over all of it."""
    usage, plan = usage_from_events(spark, folder), assignments(spark, folder)
    half = ntz("2024-01-15T06:00:00Z")
    early = ent.counter_partials(usage.filter(F.col("event_time") < half), plan)
    late = ent.counter_partials(usage.filter(F.col("event_time") >= half), plan)
    return rounded(ent.flat_counters(ent.merge_counters(early.unionByName(late))), "quantity_sum")


# --- progress, check, evaluate -----------------------------------------------------------------


@query(
    "quota_progress",
    ctes(*BASE, _progress_sql("prg", "lim", SQL_NOW))
    + f"""SELECT workspace_id, subject, plan_id, meter_name, period, period_start, period_end, aggregation, unit,
  round(current, 6) AS current, limit_value, round(greatest(limit_value - current, 0), 6) AS remaining,
  round(greatest(current - limit_value, 0), 6) AS overage, round(current / limit_value * 100, 6) AS percent,
  warning_percent, {_state("current", "limit_value", "warning_percent")} AS state, event_count FROM prg""",
)
def quota_progress(spark, folder):
    t = _Tables(spark, folder)
    rows = ent.progress(t.assignments, t.limits, t.meters, t.counters, NOW)
    return rounded(rows, "current", "remaining", "overage", "percent")


@query(
    "period_snapshots",
    ctes(*BASE, _progress_sql("prg", "lim", SQL_NOW))
    + f"""SELECT workspace_id, subject, meter_name, plan_id, period, period_start, period_end,
  {_state("current", "limit_value", "warning_percent")} AS state, round(current, 6) AS current, limit_value,
  round(greatest(least(current, limit_value), 0), 6) AS included, round(greatest(current - limit_value, 0), 6) AS overage,
  round(greatest(limit_value - current, 0), 6) AS remaining, warning_percent, event_count FROM prg""",
)
def period_snapshots(spark, folder):
    t = _Tables(spark, folder)
    rows = ent.snapshots(ent.progress(t.assignments, t.limits, t.meters, t.counters, NOW))
    return rounded(rows, "current", "included", "overage", "remaining")


@query(
    "quota_check",
    ctes(
        *BASE,
        _progress_sql("prg", "fst", SQL_NOW),
        f"""plan_now AS (SELECT workspace_id, subject, plan_id FROM asg
  WHERE assigned_at <= {SQL_NOW} AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW}))""",
        """req AS (SELECT id AS request_id, workspace_id, subject, meter_name,
  CASE WHEN quantity = 0 THEN 1.0 ELSE quantity END AS quantity FROM ev WHERE event_time >= TIMESTAMP '2024-01-25 12:00:00')""",
        """ans AS (SELECT r.*, n.plan_id AS plan_now, p.plan_id, p.period, p.period_start, p.period_end, p.current, p.limit_value,
  p.warning_percent, p.current + r.quantity AS projected
  FROM req r LEFT JOIN plan_now n USING (workspace_id, subject) LEFT JOIN prg p USING (workspace_id, subject, meter_name))""",
    )
    + f"""SELECT request_id, workspace_id, subject, meter_name, quantity, plan_now AS plan_id, period, period_start, period_end,
  round(coalesce(current, 0.0), 6) AS current, coalesce(limit_value, 0.0) AS limit_value,
  round(coalesce(greatest(limit_value - projected, 0), 0), 6) AS remaining,
  round(coalesce(greatest(projected - limit_value, 0), 0), 6) AS overage,
  coalesce(projected <= limit_value, false) AS allowed,
  CASE WHEN plan_now IS NULL THEN 'no_plan' WHEN plan_id IS NULL THEN 'not_in_plan'
       WHEN projected > limit_value THEN 'exceeded' ELSE {_state("projected", "limit_value", "warning_percent")} END AS state,
  CAST(CASE WHEN plan_id IS NOT NULL AND projected > limit_value
       THEN date_diff('second', {SQL_NOW}, period_end) ELSE 0 END AS BIGINT) AS retry_after_seconds,
  CASE WHEN plan_now IS NULL THEN 'subject is not assigned to a plan'
       WHEN plan_id IS NULL THEN 'meter is not included in the subject''s plan'
       WHEN projected > limit_value THEN 'quota would be exceeded'
       WHEN projected >= limit_value THEN 'quota is available; quota limit reached'
       WHEN projected / limit_value * 100 >= warning_percent THEN 'quota is available; warning threshold reached'
       ELSE 'quota is available' END AS message
FROM ans""",
)
def quota_check(spark, folder):
    """Every event after the evaluation time asks for its quantity."""
    t = _Tables(spark, folder)
    requests = t.usage.filter(F.col("event_time") >= ntz(NOW)).select(
        F.col("id").alias("request_id"), "workspace_id", "subject", "meter_name", "quantity"
    )
    rows = ent.check(requests, t.assignments, t.limits, t.meters, t.counters, NOW)
    return rounded(rows, "current", "remaining", "overage")


_EVALUATED = ctes(
    *BASE,
    "ev1 AS (SELECT * FROM ev WHERE event_time < TIMESTAMP '2024-01-24 12:00:00')",
    "ev2 AS (SELECT * FROM ev WHERE event_time < TIMESTAMP '2024-01-25 12:00:00')",
    *[
        CNT.replace("placed AS", f"placed{i} AS").replace("FROM ev e", f"FROM ev{i} e").replace("cnt AS", f"cnt{i} AS").replace(
            "FROM placed e", f"FROM placed{i} e"
        )
        for i in (1, 2)
    ],
    _progress_sql("before", "fst", "TIMESTAMP '2024-01-24 12:00:00'").replace("LEFT JOIN cnt c", "LEFT JOIN cnt1 c"),
    _progress_sql("after", "fst", SQL_NOW).replace("LEFT JOIN cnt c", "LEFT JOIN cnt2 c"),
    "keys AS (SELECT DISTINCT workspace_id, subject, meter_name FROM ev2 WHERE event_time >= TIMESTAMP '2024-01-24 12:00:00')",
    f"""st2 AS (SELECT a.workspace_id, a.subject, a.meter_name, a.plan_id, a.period, a.current, a.limit_value,
  {_state("a.current", "a.limit_value", "a.warning_percent")} AS state,
  CASE WHEN b.subject IS NULL THEN NULL ELSE {_state("b.current", "b.limit_value", "b.warning_percent")} END AS previous_state
  FROM after a JOIN keys k USING (workspace_id, subject, meter_name)
  LEFT JOIN before b ON b.workspace_id = a.workspace_id AND b.subject = a.subject AND b.meter_name = a.meter_name
    AND b.plan_id = a.plan_id AND b.period = a.period)""",
    """typed AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM previous_state THEN NULL
  WHEN state = 'ok' THEN CASE WHEN previous_state IS NOT NULL THEN 'recovered' END ELSE state END AS event_type FROM st2)""",
)


def _evaluated(spark, folder) -> DataFrame:
    """Yesterday's evaluation of everyone, then today's of the keys used since."""
    t = _Tables(spark, folder)
    earlier = t.usage.filter(F.col("event_time") < ntz(BEFORE))
    until_now = t.usage.filter(F.col("event_time") < ntz(NOW))
    since = until_now.filter(F.col("event_time") >= ntz(BEFORE))
    before = ent.progress(
        t.assignments, ent.first_limits(t.limits), t.meters, ent.counter_partials(earlier, t.assignments), BEFORE
    )
    counters = ent.counter_partials(until_now, t.assignments)
    return ent.evaluate(since, t.assignments, t.limits, t.meters, counters, before, NOW)


@query(
    "quota_states",
    _EVALUATED
    + """SELECT workspace_id, subject, meter_name, plan_id, period, state, previous_state, event_type,
  round(current, 6) AS current, limit_value FROM typed""",
)
def quota_states(spark, folder):
    rows = _evaluated(spark, folder).select(
        *ent.STATE_KEY, "state", "previous_state", "event_type", "current", "limit_value"
    )
    return rounded(rows, "current")


@query(
    "quota_events",
    _EVALUATED
    + """SELECT workspace_id, subject, meter_name, plan_id, period, previous_state, state, event_type AS type,
  round(current, 6) AS current, limit_value,
  CASE state WHEN 'exceeded' THEN 'quota exceeded' WHEN 'warning' THEN 'quota warning threshold reached'
    ELSE 'quota is available' END AS message FROM typed WHERE event_type IS NOT NULL""",
)
def quota_events(spark, folder):
    rows = ent.events_of(_evaluated(spark, folder)).select(
        *ent.STATE_KEY, "previous_state", "state", "type", "current", "limit_value", "message"
    )
    return rounded(rows, "current")


@query(
    "quota_state_list",
    _EVALUATED
    + """SELECT subject, meter_name, plan_id, period, state, round(current, 6) AS current FROM st2
WHERE workspace_id = 'ws_1' AND state = 'exceeded' ORDER BY round(current, 6) DESC, subject, meter_name, plan_id, period LIMIT 25""",
)
def quota_state_list(spark, folder):
    """The largest exceeded quotas of a tenant."""
    rows = rounded(_evaluated(spark, folder), "current")
    order = [("current", False), ("subject", True), ("meter_name", True), ("plan_id", True), ("period", True)]
    listed = ent.list_rows(rows, order, 25, workspace_id="ws_1", state="exceeded", subject=None)
    return listed.select("subject", "meter_name", "plan_id", "period", "state", "current")


@query(
    "quota_event_list",
    _EVALUATED
    + """SELECT subject, meter_name, plan_id, period, event_type AS type, previous_state FROM typed
WHERE workspace_id = 'ws_2' AND event_type IS NOT NULL ORDER BY event_type, subject, meter_name, plan_id, period LIMIT 40""",
)
def quota_event_list(spark, folder):
    """The transition events of a tenant, by type and key."""
    rows = ent.events_of(_evaluated(spark, folder))
    order = [(c, True) for c in ("type", "subject", "meter_name", "plan_id", "period")]
    listed = ent.list_rows(rows, order, 40, workspace_id="ws_2", meter_name="")
    return listed.select("subject", "meter_name", "plan_id", "period", "type", "previous_state")


@query(
    "period_snapshot_list",
    ctes(*BASE, _progress_sql("prg", "lim", SQL_NOW))
    + """SELECT subject, meter_name, plan_id, period, period_start, round(current, 6) AS current FROM prg
WHERE workspace_id = 'ws_0' AND meter_name = 'click' ORDER BY period_start DESC, subject, plan_id, period LIMIT 30""",
)
def period_snapshot_list(spark, folder):
    """The newest period snapshots of a meter."""
    t = _Tables(spark, folder)
    rows = ent.snapshots(ent.progress(t.assignments, t.limits, t.meters, t.counters, NOW))
    order = [("period_start", False), ("subject", True), ("plan_id", True), ("period", True)]
    listed = ent.list_rows(rows, order, 30, workspace_id="ws_0", meter_name="click")
    return rounded(listed.select("subject", "meter_name", "plan_id", "period", "period_start", "current"), "current")


@query(
    "assignment_list_of_plan",
    ctes(ASG)
    + f"""SELECT id, subject, assigned_at, CASE WHEN assigned_at > {SQL_NOW} THEN 'scheduled' ELSE 'active' END AS status
FROM asg WHERE plan_id = 'pro' AND (unassigned_at IS NULL OR unassigned_at > {SQL_NOW})""",
)
def assignment_list_of_plan(spark, folder):
    """The open assignments of one plan."""
    rows = ent.list_assignments(assignments(spark, folder), plans(spark), NOW, plan_id="pro")
    return rows.select("id", "subject", "assigned_at", "status")


@query(
    "quota_transitions",
    ctes(
        *BASE,
        # All events so far in the window, per hour that has events, brute force.
        """ticks AS (SELECT DISTINCT p.workspace_id, p.subject, p.meter_name, p.plan_id, p.period_anchor_at, l.period,
  l.limit_value, l.warning_percent, date_trunc('hour', p.event_time)::TIMESTAMP + INTERVAL 1 HOUR AS tick,
  w.period_start, w.period_end
  FROM placed p JOIN fst l ON l.workspace_id = p.workspace_id AND l.plan_id = p.plan_id AND l.meter_name = p.meter_name
  JOIN win w ON w.workspace_id = p.workspace_id AND w.subject = p.subject AND w.period = l.period
    AND p.event_time >= w.period_start AND p.event_time < w.period_end)""",
        """vals AS (SELECT t.workspace_id, t.subject, t.meter_name, t.plan_id, t.period, t.period_start, t.tick, t.limit_value,
  t.warning_percent, count(*) AS event_count, sum(quantity) AS quantity_sum, max(quantity) AS quantity_max,
  first(quantity ORDER BY event_time DESC, received_at DESC, p.id DESC) AS last_quantity
  FROM ticks t JOIN placed p ON p.workspace_id = t.workspace_id AND p.subject = t.subject AND p.meter_name = t.meter_name
    AND p.event_time >= t.period_start AND p.event_time < t.period_end AND p.event_time < t.tick
  GROUP BY ALL)""",
        f"""seen AS (SELECT c.workspace_id, c.subject, c.meter_name, c.plan_id, c.period, c.period_start, c.tick, c.limit_value,
  {VALUE} AS current, c.warning_percent FROM vals c JOIN met m ON m.workspace_id = c.workspace_id AND m.name = c.meter_name)""",
        f"""sts AS (SELECT *, {_state("current", "limit_value", "warning_percent")} AS state FROM seen)""",
        """lagged AS (SELECT *, lag(state) OVER (PARTITION BY workspace_id, subject, meter_name, plan_id, period
  ORDER BY tick, period_start) AS previous_state FROM sts)""",
    )
    + """SELECT * FROM (SELECT workspace_id, subject, meter_name, plan_id, period, period_start, tick, previous_state, state,
  CASE WHEN state IS NOT DISTINCT FROM previous_state THEN NULL
    WHEN state = 'ok' THEN CASE WHEN previous_state IS NOT NULL THEN 'recovered' END ELSE state END AS type,
  round(current, 6) AS current, limit_value FROM lagged) WHERE type IS NOT NULL""",
)
def quota_transitions(spark, folder):
    t = _Tables(spark, folder)
    rows = ent.replay_transitions(t.usage, t.assignments, t.limits, t.meters)
    return rounded(rows, "current")


# --- preview -----------------------------------------------------------------------------------

_PREVIEW = ctes(
    *BASE,
    _limits_sql("raw_prop", _proposed_rows()),
    "prop AS (SELECT * REPLACE (CASE WHEN warning_percent = 0 THEN 80.0 ELSE warning_percent END AS warning_percent) FROM raw_prop)",
    """both_limits AS (SELECT coalesce(l.workspace_id, p.workspace_id) AS workspace_id, coalesce(l.plan_id, p.plan_id) AS plan_id,
  coalesce(l.meter_name, p.meter_name) AS meter_name, coalesce(l.period, p.period) AS period,
  l.limit_value AS current_limit, l.warning_percent AS cw, p.limit_value AS proposed_limit, p.warning_percent AS pw
  FROM lim l FULL JOIN prop p USING (workspace_id, plan_id, meter_name, period))""",
    f"""items AS (SELECT a.workspace_id, a.subject, a.plan_id, b.meter_name, b.period, {VALUE} AS current,
  b.current_limit, b.cw, b.proposed_limit, b.pw
  FROM (SELECT * FROM asg WHERE unassigned_at IS NULL OR unassigned_at > {SQL_NOW}) a
  JOIN both_limits b ON b.workspace_id = a.workspace_id AND b.plan_id = a.plan_id
  JOIN met m ON m.workspace_id = a.workspace_id AND m.name = b.meter_name
  JOIN win w ON w.workspace_id = a.workspace_id AND w.subject = a.subject AND w.period = b.period
    AND w.period_start <= {SQL_NOW} AND w.period_end > {SQL_NOW}
  LEFT JOIN cnt c ON c.workspace_id = a.workspace_id AND c.subject = a.subject AND c.meter_name = b.meter_name
    AND c.period = b.period AND c.period_start = w.period_start)""",
    f"""rated AS (SELECT *,
  CASE WHEN current_limit IS NULL THEN 'not_in_plan' ELSE {_state("current", "current_limit", "cw")} END AS current_state,
  CASE WHEN proposed_limit IS NULL THEN 'not_in_plan' ELSE {_state("current", "proposed_limit", "pw")} END AS proposed_state,
  proposed_limit IS NULL AS removed FROM items)""",
    """subs AS (SELECT workspace_id, subject, plan_id,
  CASE WHEN bool_or(proposed_state = 'exceeded') THEN 'exceeded' WHEN bool_or(proposed_state = 'warning') THEN 'warning'
    ELSE 'ok' END AS worst_state, count(*) FILTER (removed) AS removed_limits FROM rated GROUP BY 1, 2, 3)""",
)


def _preview(spark, folder) -> DataFrame:
    t = _Tables(spark, folder)
    return ent.preview(t.assignments, t.limits, limits(spark, _proposed_rows()), t.meters, t.counters, NOW)


@query(
    "plan_preview",
    _PREVIEW
    + """SELECT workspace_id, subject, plan_id, meter_name, period, round(current, 6) AS current, current_limit, proposed_limit,
  current_state, proposed_state, removed FROM rated""",
)
def plan_preview(spark, folder):
    return rounded(_preview(spark, folder), "current")


@query("plan_preview_subjects", _PREVIEW + "SELECT workspace_id, subject, plan_id, worst_state, removed_limits FROM subs")
def plan_preview_subjects(spark, folder):
    return ent.preview_subjects(_preview(spark, folder))


@query(
    "plan_preview_summary",
    _PREVIEW
    + """SELECT workspace_id, plan_id, count(*) AS subjects, count(*) FILTER (worst_state = 'ok') AS ok,
  count(*) FILTER (worst_state = 'warning') AS warning, count(*) FILTER (worst_state = 'exceeded') AS exceeded,
  CAST(sum(removed_limits) AS BIGINT) AS removed_limits FROM subs GROUP BY 1, 2""",
)
def plan_preview_summary(spark, folder):
    return ent.preview_summary(_preview(spark, folder))


# --- validation -----------------------------------------------------------------------------------


@query(
    "plan_validation",
    """WITH p AS (SELECT 'ws_' || CAST(p_partkey % 3 AS VARCHAR) AS workspace_id, CAST(p_partkey AS VARCHAR) AS plan_id,
  p_brand, p_retailprice, p_size, p_type FROM part)
SELECT workspace_id, plan_id, p_brand AS meter_name,
  CASE WHEN p_size <= 10 THEN 'day' WHEN p_size <= 45 THEN 'month' ELSE 'quarter' END AS period,
  CASE WHEN p_brand = 'Brand#9' THEN 'meter was not found' WHEN p_size > 45 THEN 'unsupported plan period'
       WHEN 1800 - p_retailprice <= 0 THEN 'limit must be greater than zero'
       ELSE 'warning percent must be greater than zero and at most 100' END AS message
FROM p WHERE p_brand = 'Brand#9' OR p_size > 45 OR p_retailprice >= 1800 OR p_size * 3 > 100
UNION ALL
SELECT workspace_id, plan_id, NULL, NULL, 'plan name is required' FROM p WHERE p_type = 'ECONOMY'""",
)
def plan_validation(spark, folder):
    """Parts as plans: the brand is the meter, the size gives period and warning, the price the limit."""
    part = table(spark, folder, "part")
    workspace = workspace_of(F.col("p_partkey")).alias("workspace_id")
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    plan_rows = part.select(
        key.alias("id"),
        workspace,
        F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.col("p_name")).alias("name"),
    )
    limit_rows = part.select(
        workspace,
        key.alias("plan_id"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("meter_name"),
        F.when(size <= 10, " Day").when(size <= 45, "").otherwise("quarter").alias("period"),
        (F.lit(1800) - F.col("p_retailprice")).alias("limit_value"),
        (size * 3).cast("double").alias("warning_percent"),
    )
    known = part.filter("p_brand <> 'Brand#9'").select(workspace, F.col("p_brand").alias("name")).distinct()
    return ent.validate_plans(plan_rows, limit_rows, known)


@query(
    "late_events",
    ctes(
        *BASE[:4],
        """ev_ok AS (SELECT * EXCLUDE (rn, received_at), late AS received_at FROM (
  SELECT *, CAST(id AS BIGINT) % 5 = 0 AS late, row_number() OVER (PARTITION BY workspace_id, idempotency_key
    ORDER BY CAST(id AS BIGINT) % 5 = 0, CAST(id AS BIGINT)) AS rn FROM ev WHERE quantity > 0) WHERE rn = 1)""",
        CNT.replace("FROM ev e", "FROM ev_ok e"),
        *BASE[5:],
        f"""changed AS (SELECT DISTINCT e.workspace_id, e.subject, e.meter_name, w.period, w.period_start
  FROM placed e JOIN win w ON w.workspace_id = e.workspace_id AND w.subject = e.subject
   AND e.event_time >= w.period_start AND e.event_time < w.period_end WHERE e.late AND w.period_end <= {SQL_NOW})""",
        f"""late AS (SELECT c.workspace_id, c.subject, c.meter_name, a.plan_id, c.period, c.period_start, c.event_count,
    l.limit_value, l.warning_percent, {VALUE} AS current
  FROM changed JOIN cnt c USING (workspace_id, subject, meter_name, period, period_start)
  JOIN asg a ON a.workspace_id = c.workspace_id AND a.subject = c.subject AND a.assigned_at < c.period_end
   AND (a.unassigned_at IS NULL OR a.unassigned_at >= c.period_end)
  JOIN fst l ON l.workspace_id = c.workspace_id AND l.plan_id = a.plan_id AND l.meter_name = c.meter_name AND l.period = c.period
  JOIN met m ON m.workspace_id = c.workspace_id AND m.name = c.meter_name)""",
    )
    + f"""SELECT workspace_id, subject, meter_name, plan_id, period, period_start, event_count, limit_value,
  {_state("current", "limit_value", "warning_percent")} AS state, round(current, 6) AS current FROM late""",
)
def late_events(spark, folder):
    """A committed batch, then one with a fifth of the events, all of them old: the closed windows that it changes."""
    store, meters = EventStore(spark, scratch_path(spark, "late-events")), event_meters(spark, folder)
    raw, history = raw_from_usage(usage_from_events(spark, folder)), assignments(spark, folder)
    late = F.col("index") % 5 == 0
    store.ingest(raw.filter(~late), meters, "on-time", NOW, assignments=history)
    store.ingest(raw.filter(late), meters, "late", "2024-02-01T00:00:00Z", assignments=history)
    rows = store.late_windows("late", NOW, history, limits(spark), meters)
    columns = [*ent.STATE_KEY, "period_start", "event_count", "limit_value", "state", "current"]
    return rounded(rows.select(*columns), "current")
