"""Assignments, counters, progress, checks, evaluation and previews."""

from datetime import timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from sample_values import at
from meterframe.operators import entitlements as ent
from meterframe.schema import ASSIGNMENT
from meterframe.session import scratch_path
from meterframe.sources.store import EventStore

NOW = "2026-06-20T12:00:00Z"
START = at("2026-06-01 00:00")
REQUEST = "request_id string, workspace_id string, subject string, meter_name string, quantity double"
KEY = "workspace_id string, subject string, meter_name string, plan_id string, period string, state string"


def used(make, *quantities, **more):
    rows = [
        {"event_time": START + timedelta(days=1, hours=i), "quantity": float(q), **more} for i, q in enumerate(quantities)
    ]
    return make.usage(*rows)


def ask(make, usage, quantity, **more):
    row = {"request_id": "r", "meter_name": "api_calls", "subject": "org_123", "quantity": float(quantity), **more}
    assignments = make.assignments({"assigned_at": START})
    return ent.check(
        make.frame([row], REQUEST, workspace_id="ws"),
        assignments,
        make.limits({}),
        make.meters(),
        ent.counter_partials(usage, assignments),
        NOW,
    ).first()


def test_check(make):
    row = ask(make, used(make), 3)
    assert (row["allowed"], row["state"], row["remaining"]) == (True, "ok", 7.0)
    row = ask(make, used(make, 3, 5), 1)
    assert (row["allowed"], row["state"], row["remaining"]) == (True, "warning", 1.0)
    row = ask(make, used(make, 3, 5), 3)
    assert (row["allowed"], row["state"], row["overage"]) == (False, "exceeded", 1.0)
    assert row["retry_after_seconds"] == int((at("2026-07-01 00:00") - at("2026-06-20 12:00")).total_seconds())
    row = ask(make, used(make, 3, 5), 2)
    assert (row["allowed"], row["state"]) == (True, "exceeded")
    assert row["message"] == "quota is available; quota limit reached"
    assert ask(make, used(make), 0)["quantity"] == 1.0
    assert ask(make, used(make), 1, subject="nobody")["state"] == "no_plan"
    assert ask(make, used(make), 1, meter_name="storage")["state"] == "not_in_plan"


def test_progress(make):
    assignments = make.assignments({"assigned_at": START})
    counters = ent.counter_partials(used(make, 3, 5), assignments)
    row = ent.progress(assignments, make.limits({}), make.meters(), counters, NOW).first()
    assert (row["current"], row["remaining"], row["state"], row["event_count"]) == (8.0, 2.0, "warning", 2)
    assert (row["period_start"], row["period_end"]) == (START, at("2026-07-01 00:00"))


@pytest.mark.parametrize(
    "aggregation, expected",
    [("sum", 9.0), ("count", 3.0), ("avg", 3.0), ("min", 1.0), ("max", 5.0), ("first", 3.0), ("last", 1.0), ("rate", 3 / (30 * 86400))],
)
def test_counter_value_by_aggregation(make, aggregation, expected):
    assignments = make.assignments({"assigned_at": START})
    counters = ent.counter_partials(used(make, 3, 5, 1), assignments)
    meters = make.meters({"aggregation": aggregation})
    row = ent.progress(assignments, make.limits({}), meters, counters, NOW).first()
    assert row["current"] == pytest.approx(expected)


def test_day_partials_fan_out_in_all_shuffle_partitions(make, capsys):
    """Each day's partial becomes four rows that are sorted: the partials are not merged into a few large tasks before."""
    ent.counter_partials(used(make, 3, 5, 1), make.assignments({"assigned_at": START})).explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and "day_index" in dealt[0]


def test_events_outside_an_assignment_do_not_count(make):
    assignments = make.assignments({"assigned_at": at("2026-06-02 01:00"), "unassigned_at": at("2026-06-02 03:00")})
    counters = ent.counter_partials(used(make, 1, 10, 100, 1000), assignments)
    assert {r["quantity_sum"] for r in counters.collect()} == {110.0}
    assert counters.count() == 4


def test_ties_first_kept_last_replaced(make):
    time = at("2026-06-02 10:00")
    usage = make.usage(
        {"event_time": time, "received_at": time + timedelta(seconds=2), "quantity": 2.0},
        {"event_time": time, "received_at": time + timedelta(seconds=1), "quantity": 1.0},
        {"event_time": time, "received_at": time + timedelta(seconds=3), "quantity": 3.0},
    )
    counters = ent.counter_partials(usage, make.assignments({"assigned_at": START}))
    row = ent.flat_counters(counters).first()
    assert (row["first_quantity"], row["last_quantity"]) == (1.0, 3.0)


def test_hot_subject_takes_the_salted_join(spark, make, monkeypatch):
    """A third of all events belong to one subject: same counters as with a broadcast."""
    rows = [
        {
            "subject": "hot" if i % 3 == 0 else f"s{i % 40}",
            "event_time": START + timedelta(hours=i % 200, seconds=i),
            "quantity": float(i % 17 + 1),
        }
        for i in range(900)
    ]
    usage = make.usage(*rows)
    assignments = make.assignments(*[{"subject": s, "assigned_at": START} for s in ["hot", *{f"s{i}" for i in range(40)}]])

    def counted():
        df = ent.flat_counters(ent.counter_partials(usage, assignments))
        plan = df._jdf.queryExecution().toString()
        return sorted(map(tuple, df.collect())), plan

    plain, _ = counted()
    monkeypatch.setattr(ent, "fits", lambda *_: False)
    salted, plan = counted()
    assert "__salt" in plan
    assert salted == plain


def test_first_limit_goes_by_period_name(make):
    limits = make.limits({"period": "week"}, {"period": "day", "limit_value": 1.0}, {"period": "month"})
    assert [r["period"] for r in ent.first_limits(limits).collect()] == ["day"]


def test_future_plan_is_not_in_effect_yet(make):
    assignments = make.assignments(
        {"assigned_at": START, "unassigned_at": at("2026-06-21 12:00")},
        {"assigned_at": at("2026-06-21 12:00"), "plan_id": "p2", "period_anchor_at": START},
    )
    plans = make.plans({"id": "p1"}, {"id": "p2", "name": "Future"})
    rows = ent.list_assignments(assignments, plans, NOW).collect()
    assert {(r["plan_name"], r["status"]) for r in rows} == {("Pro", "active"), ("Future", "scheduled")}
    limits = make.limits({}, {"plan_id": "p2", "meter_name": "storage"})
    row = make.frame([{"request_id": "r", "meter_name": "storage", "subject": "org_123", "quantity": 1.0}], REQUEST, workspace_id="ws")
    counters = ent.counter_partials(used(make), assignments)
    got = ent.check(row, assignments, limits, make.meters({}, {"name": "storage"}), counters, NOW).first()
    assert got["state"] == "not_in_plan"


# --- assignment history ------------------------------------------------------------


def assign_one(rows, command):
    """One assign command applied to a list of rows, statement by statement."""
    now = command["issued_at"]
    effective = max(command["effective_at"] or now, now)
    active = [r for r in rows if r["assigned_at"] <= now and (r["unassigned_at"] is None or r["unassigned_at"] > now)]
    anchor = effective.replace(microsecond=0)
    if active:
        anchor = max(active, key=lambda r: (r["assigned_at"], r["updated_at"], r["n"]))["period_anchor_at"]
    for row in rows:
        if row["assigned_at"] > now and (row["unassigned_at"] is None or row["unassigned_at"] > now):
            row["unassigned_at"] = now
    for row in rows:
        if row["assigned_at"] < effective and (row["unassigned_at"] is None or row["unassigned_at"] > effective):
            row["unassigned_at"] = effective
    rows.append(
        {
            "id": command["id"],
            "assigned_at": effective,
            "period_anchor_at": anchor,
            "unassigned_at": None,
            "updated_at": now,
            "n": len(rows),
        }
    )


def test_assign_equals_one_command_at_a_time(spark, make):
    random = Random(11)
    history, commands, expected = [], [], {}
    for n in range(150):
        subject = f"s{n}"
        rows, clock = [], at("2026-01-01 00:00") + timedelta(microseconds=random.randrange(10**9))
        count = random.randrange(1, 8)
        existing = random.randrange(0, count)
        for i in range(count):
            clock += timedelta(hours=random.randrange(1, 100), microseconds=random.randrange(10**6))
            effective = clock + timedelta(hours=random.choice([-50, 0, 0, 30, 90, 200]))
            command = {"id": f"{subject}-{i}", "issued_at": clock, "effective_at": random.choice([None, effective])}
            if i == existing:
                history += [{**r, "subject": subject} for r in map(dict, rows)]
            if i >= existing:
                commands.append({**command, "subject": subject})
            assign_one(rows, command)
        expected[subject] = {(r["id"], r["assigned_at"], r["period_anchor_at"], r["unassigned_at"]) for r in rows}
    schema = (
        "id string, workspace_id string, subject string, plan_id string, effective_at timestamp_ntz, issued_at timestamp_ntz"
    )
    before = make.frame(history, ASSIGNMENT, workspace_id="ws", plan_id="p1")
    got = {}
    for r in ent.assign(before, make.frame(commands, schema, workspace_id="ws", plan_id="p1")).collect():
        got.setdefault(r["subject"], set()).add((r["id"], r["assigned_at"], r["period_anchor_at"], r["unassigned_at"]))
    for subject, rows in expected.items():
        assert got[subject] == rows, subject


def test_unassign_ends_open_and_future_rows(make):
    rows = make.assignments(
        {"assigned_at": START, "unassigned_at": at("2026-06-21 00:00")},
        {"assigned_at": at("2026-06-21 00:00")},
        {"assigned_at": at("2026-01-01 00:00"), "unassigned_at": START},
        {"assigned_at": START, "subject": "other"},
    )
    ended = ent.unassign(rows, rows.filter("subject = 'org_123'"), NOW)
    got = {r["id"]: r["unassigned_at"] for r in ended.collect()}
    now = at("2026-06-20 12:00")
    assert got == {"a0": now, "a1": now, "a2": START, "a3": None}


def test_effective_intervals_are_disjoint_and_skip_cancelled(make):
    rows = make.assignments(
        {"assigned_at": START, "unassigned_at": at("2026-06-10 00:00")},
        {"assigned_at": at("2026-06-15 00:00"), "unassigned_at": at("2026-06-05 00:00")},
        {"assigned_at": at("2026-06-10 00:00"), "plan_id": "p2"},
    )
    got = sorted((r["plan_id"], r["valid_from"], r["valid_to"]) for r in ent.effective_intervals(rows).collect())
    assert got == [("p1", START, at("2026-06-10 00:00")), ("p2", at("2026-06-10 00:00"), None)]


def test_a_thousand_overlapping_assignments(make, capsys):
    """Each piece of time has the newest assignment alive in it; no product of rows and pieces."""
    random, rows = Random(5), []
    for i in range(1000):
        start = START + timedelta(minutes=random.randrange(50_000))
        end = None if i % 97 == 0 else start + timedelta(minutes=random.choice([1, 60, 3000, 40_000]))
        rows.append({"id": f"a{i}", "plan_id": f"p{i}", "assigned_at": start, "updated_at": start + timedelta(seconds=i), "unassigned_at": end})
    far = at("9999-12-31 23:59:59")
    cuts = sorted({r["assigned_at"] for r in rows} | {r["unassigned_at"] or far for r in rows})
    expected = set()
    for cut, until in zip(cuts, cuts[1:]):
        alive = [r for r in rows if r["assigned_at"] <= cut < (r["unassigned_at"] or far)]
        if alive:
            newest = max(alive, key=lambda r: (r["assigned_at"], r["updated_at"]))
            expected.add((newest["plan_id"], cut, until if until < far else None))
    table = make.assignments(*rows, {"id": "other", "subject": "org_1", "assigned_at": START})
    intervals = ent.effective_intervals(table)
    got = intervals.filter("subject = 'org_123'").collect()
    assert len(got) == len(expected) and {(r["plan_id"], r["valid_from"], r["valid_to"]) for r in got} == expected
    assert [r["valid_to"] for r in intervals.filter("subject = 'org_1'").collect()] == [None]
    ends = F.coalesce("unassigned_at", F.lit(far))
    ent.newest_pieces(table.withColumn("valid_from", F.col("assigned_at")).withColumn("ends", ends)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Window [") == plan.count("dense_rank(") <= 2
    assert all("node" in line for line in plan.split("\n") if "Join [" in line)


# --- plan changes ---------------------------------------------------------------------


def test_plan_update_moves_subjects_and_keeps_the_anchor(spark, make):
    """Use 13 of 10, raise the limit to 20 with a warning at 60 percent."""
    store = EventStore(spark, scratch_path(spark, "quota"))
    meters, plans, limits = make.meters(), make.plans({"id": "p1"}), make.limits({})
    assignments = make.assignments({"assigned_at": START})
    raw = make.raw({"quantity": 13.0, "idempotency_key": "k", "timestamp": at("2026-06-10 00:00")})
    store.ingest(raw, meters, "b1", NOW, assignments=assignments)
    store.evaluate_quotas("b1", assignments, limits, meters, NOW)
    assert [(r["state"], r["current"]) for r in store.quota_states().collect()] == [("exceeded", 13.0)]

    updates = make.frame(
        [{"plan_id": "p1", "name": " Pro ", "description": ""}],
        "workspace_id string, plan_id string, name string, description string",
        workspace_id="ws",
    )
    later = "2026-06-21T00:00:00Z"
    plans, limits, assignments = ent.new_versions(
        plans, limits, assignments, updates, make.limits({"limit_value": 20.0, "warning_percent": 60.0}), later
    )
    current = plans.filter("is_current").first()
    assert (current["version"], current["parent_plan_id"], current["name"]) == (2, "p1", "Pro")
    live = assignments.filter("unassigned_at is null").first()
    assert (live["plan_id"], live["period_anchor_at"]) == (current["id"], START)

    # The key was used before: nothing is accepted, so nothing is evaluated.
    store.ingest(make.raw({"quantity": 9.0, "idempotency_key": "k"}), meters, "b2", later, assignments=assignments)
    store.evaluate_quotas("b2", assignments, limits, meters, later)
    # An accepted event of another day triggers the evaluation on version 2.
    more = make.raw({"quantity": 1e-9, "timestamp": at("2026-06-21 00:00")})
    store.ingest(more, meters, "b3", later, assignments=assignments)
    store.evaluate_quotas("b3", assignments, limits, meters, later)
    store.evaluate_quotas("b3", assignments, limits, meters, later)
    events = [(r["type"], r["plan_id"] == current["id"]) for r in store.quota_events().orderBy("created_at").collect()]
    assert events == [("exceeded", False), ("warning", True)]
    snapshot = store.quota_snapshots().filter(F.col("plan_id") == current["id"]).first()
    assert (snapshot["event_count"], snapshot["state"], snapshot["period_start"]) == (2, "warning", START)
    counters = store.counters()
    for quantity, allowed, state in ((2.0, True, "warning"), (8.0, False, "exceeded")):
        request = make.frame([{"request_id": "r", "meter_name": "api_calls", "subject": "org_123", "quantity": quantity}], REQUEST, workspace_id="ws")
        row = ent.check(request, assignments, limits, meters, counters, "2026-06-21T00:00:01Z").first()
        assert (row["allowed"], row["state"]) == (allowed, state)


def test_preview(make):
    assignments = make.assignments({"assigned_at": START})
    counters = ent.counter_partials(used(make, 8), assignments)
    proposed = make.limits({"limit_value": 5.0}, {"meter_name": "storage", "limit_value": 100.0, "warning_percent": None})
    items = ent.preview(assignments, make.limits({}), proposed, make.meters({}, {"name": "storage"}), counters, NOW)
    got = {r["meter_name"]: (r["current"], r["current_limit"], r["proposed_limit"], r["current_state"], r["proposed_state"]) for r in items.collect()}
    assert got == {
        "api_calls": (8.0, 10.0, 5.0, "warning", "exceeded"),
        "storage": (0.0, None, 100.0, "not_in_plan", "ok"),
    }
    row = ent.preview_summary(items).first()
    assert (row["subjects"], row["ok"], row["warning"], row["exceeded"], row["removed_limits"]) == (1, 0, 0, 1, 0)
    removed = ent.preview(
        assignments, make.limits({}), make.limits({"meter_name": "storage"}), make.meters({}, {"name": "storage"}), counters, NOW
    )
    assert ent.preview_summary(removed).first()["removed_limits"] == 1


def test_transition_types(spark):
    rows = [(p, s) for p in (None, "ok", "warning", "exceeded") for s in ("ok", "warning", "exceeded")]
    df = spark.createDataFrame(rows, "p string, s string")
    got = {(r["p"], r["s"]): r["t"] for r in df.select("p", "s", ent.transition_type(F.col("p"), F.col("s")).alias("t")).collect()}
    for previous, state in rows:
        expected = None if previous == state else {"ok": "recovered" if previous else None}.get(state, state)
        assert got[(previous, state)] == expected


def test_plan_validation(make):
    plans = make.plans({"id": "good"}, {"id": "long", "name": "x" * 121}, {"id": "empty"})
    limits = make.limits(
        {"plan_id": "good", "period": "", "warning_percent": 0.0},
        {"plan_id": "long"},
        {"plan_id": "long", "period": " MONTH "},
        {"plan_id": "good", "meter_name": "storage"},
        {"plan_id": "good", "period": "day", "limit_value": float("inf")},
        {"plan_id": "good", "period": "week", "warning_percent": 101.0},
        {"plan_id": "good", "period": "hour"},
    )
    got = sorted((r["plan_id"], r["message"]) for r in ent.validate_plans(plans, limits, make.meters()).collect())
    assert got == [
        ("empty", "at least one plan limit is required"),
        ("good", "limit must be greater than zero"),
        ("good", "meter was not found"),
        ("good", "unsupported plan period"),
        ("good", "warning percent must be greater than zero and at most 100"),
        ("long", "duplicate limit for meter and period"),
        ("long", "plan name cannot exceed 120 characters"),
    ]
