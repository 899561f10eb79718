"""Alert evaluation, transitions, backtest and outbox."""

import json
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sample_values import at
from meterframe.operators import alerts
from meterframe.plans.spec import QuerySpec, overview, run_specs
from meterframe.operators.exports import export_status, run_exports
from meterframe.schema import ALERT_RULE, ALERT_STATE
from meterframe.session import scratch_path
from meterframe.sources.store import EventStore

NOW = "2026-06-08T12:00:00Z"


@pytest.fixture
def rules(make):
    def build(*rows):
        defaults = {
            "rule_id": "r1",
            "workspace_id": "ws",
            "name": "Rule",
            "meter_name": "api_calls",
            "enabled": True,
            "subject": "",
            "metadata": {},
            "window_seconds": 3600,
            "comparator": "gte",
            "threshold": 10.0,
            "evaluation_interval_seconds": 60,
            "group_by": "",
            "next_evaluate_at": at("2026-06-08 12:00"),
        }
        return make.frame(list(rows) or [{}], ALERT_RULE, **defaults)

    return build


def usage(make, *rows):
    return make.usage(
        *[
            {"subject": s, "quantity": float(q), "event_time": at(f"2026-06-08 {t}"), "metadata": json.dumps(m)}
            for s, q, t, m in rows
        ]
    )


def no_states(spark):
    return spark.createDataFrame([], ALERT_STATE)


def test_grouped_alert_triggers_only_for_the_loud_subject(spark, make, rules):
    orders = {"endpoint": "/orders"}
    events = usage(
        make,
        ("loud", 12, "11:30", orders),
        ("quiet", 4, "11:30", orders),
        ("loud", 50, "10:59:59", orders),
        ("other", 99, "11:30", {"endpoint": "/users"}),
    )
    rule = rules({"group_by": "subject", "metadata": {"endpoint": "/orders"}})
    got = alerts.evaluate(rule, events, make.meters(), no_states(spark), NOW)
    rows = {r["group_value"]: (r["status"], r["event_type"], r["message"]) for r in got.collect()}
    assert rows == {
        "loud": ("alerting", "triggered", "value 12.0000 gte threshold 10.0000 for subject loud"),
        "quiet": ("ok", None, "value 4.0000 is within threshold 10.0000 for subject quiet"),
    }
    payload = json.loads(alerts.outbox(alerts.events_of(got), rule, alerts.states(got)).first()["payload"])
    assert payload["event"]["type"] == "triggered" and payload["event"]["group_value"] == "loud"
    assert payload["rule"]["metadata"] == {"endpoint": "/orders"} and "subject" not in payload["rule"]
    assert payload["state"]["evaluated_at"] == NOW


def test_vanished_group_resolves(spark, make, rules):
    rule = rules({"group_by": "subject"})
    meters = make.meters()
    first = alerts.evaluate(rule, usage(make, ("a", 12, "11:30", {})), meters, no_states(spark), NOW)
    later = "2026-06-08T14:00:00Z"
    second = alerts.evaluate(rule, usage(make, ("b", 1, "13:30", {})), meters, alerts.states(first), later)
    rows = {r["group_value"]: (r["status"], r["event_type"]) for r in second.collect()}
    assert rows == {"a": ("no_data", "resolved"), "b": ("ok", None)}


def test_silent_rules(spark, make, rules):
    table = rules({}, {"rule_id": "r2", "group_by": "subject"}, {"rule_id": "r3", "enabled": False})
    got = alerts.evaluate(table, usage(make), make.meters(), no_states(spark), NOW)
    rows = {r["rule_id"]: (r["group_key"], r["status"], r["message"]) for r in got.collect()}
    assert rows == {
        "r1": ("", "no_data", "no usage data in alert window"),
        "r2": ("", "no_data", "no usage data in alert window"),
        "r3": ("", "ok", "alert rule is disabled"),
    }
    due = alerts.due_rules(table, NOW)
    assert {r["rule_id"] for r in due.collect()} == {"r1", "r2"}


def test_grouped_rule_is_strict_on_metadata(spark, make, rules):
    events = usage(make, ("a", 5, "11:30", {"code": 200}), ("b", 5, "11:30", {"code": "200"}))
    rule = rules({"group_by": "subject", "metadata": {"code": "200"}})
    got = alerts.evaluate(rule, events, make.meters(), no_states(spark), NOW)
    assert {r["group_value"] for r in got.collect()} == {"b"}  # a grouped rule compares by type


@pytest.mark.parametrize("comparator, hit", [("gt", False), ("gte", True), ("lt", False), ("lte", True), ("eq", True), ("neq", False)])
def test_comparators(spark, comparator, hit):
    df = spark.createDataFrame([(comparator, 5.0, 5.0)], "c string, v double, t double")
    assert df.select(alerts.compare(F.col("c"), F.col("v"), F.col("t"))).first()[0] is hit


@pytest.mark.parametrize("aggregation", ["last", "rate"])
def test_backtest_equals_evaluating_every_tick(spark, make, rules, aggregation):
    """Window 50 minutes, step 20 minutes: the panes are 10 minutes wide."""
    rows = [
        (s, q, t, {})
        for s, q, t in [
            ("a", 12, "09:55", ), ("a", 1, "10:30"), ("b", 4, "10:00"), ("b", 30, "10:10"), ("a", 20, "11:45"),
            ("b", 2, "11:50:00.5"), ("a", 3, "11:59:59.999999"), ("c", 11, "10:20"), ("c", 11, "12:10"),
        ]
    ]
    events, meters = usage(make, *rows), make.meters({"aggregation": aggregation})
    threshold = 0.0005 if aggregation == "rate" else 10.0
    base = {"window_seconds": 3000, "evaluation_interval_seconds": 1200, "threshold": threshold}
    table = rules({**base, "group_by": "subject"}, {**base, "rule_id": "r2"}, {**base, "rule_id": "r3", "subject": "a", "comparator": "lt"})
    start, end = at("2026-06-08 09:00"), at("2026-06-08 13:30")
    state, expected, tick = no_states(spark), [], start
    states = []
    while tick <= end:
        evaluated = alerts.evaluate(table, events, meters, make.frame(states, ALERT_STATE, workspace_id="ws"), tick).collect()
        expected += [(r["rule_id"], r["group_value"], tick, r["event_type"]) for r in evaluated if r["event_type"]]
        states = [
            {k: r[k] for k in ("rule_id", "group_key", "group_value", "status")} for r in evaluated
        ]
        tick += timedelta(seconds=1200)
    got = alerts.backtest(table, events, meters, start, end)
    assert sorted((r["rule_id"], r["group_value"], r["at"], r["type"]) for r in got.collect()) == sorted(expected)
    assert expected


def test_backtest_of_a_short_interval_looks_at_changes_only(make, rules):
    """Two days of one-second ticks; an event counts for the 3,600 ticks after it, a year's window for all."""
    events, meters = usage(make, ("a", 12, "10:00:00.5", {}), ("a", 1, "10:30", {})), make.meters()
    table = rules(
        {"evaluation_interval_seconds": 1},
        {"rule_id": "year", "window_seconds": 366 * 86400, "evaluation_interval_seconds": 1},
    )
    start, end = at("2026-06-07 00:00"), at("2026-06-09 00:00")
    got = [(r["rule_id"], r["at"], r["type"], r["value"]) for r in alerts.backtest(table, events, meters, start, end).collect()]
    assert sorted(got) == [
        ("r1", at("2026-06-08 10:00:01"), "triggered", 12.0),
        ("r1", at("2026-06-08 11:00:01"), "resolved", 1.0),
        ("year", at("2026-06-08 10:00:01"), "triggered", 12.0),
    ]
    values = alerts.backtest_values(table.filter("rule_id = 'r1'"), events, meters, start, end)
    assert values.groupBy().agg(F.count("*"), F.sum("event_count")).first()[:] == (5400, 7200)  # ticks 36,001 to 41,400 of the second day


def test_backtest_frames_run_in_all_shuffle_partitions(make, rules, capsys):
    """Both frames of a block sort their rows: those are dealt out once, and not merged into a few large tasks."""
    events, meters = usage(make, ("a", 12, "10:00:00.5", {}), ("a", 1, "10:30", {})), make.meters()
    alerts.backtest_runs(rules({}), events, meters, at("2026-06-08 00:00"), at("2026-06-09 00:00")).explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if "hashpartitioning" in line and "block" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_primary_state_is_the_worst(make):
    rows = [
        {"group_key": "subject", "group_value": v, "status": s, "updated_at": at(f"2026-06-08 {t}")}
        for v, s, t in [("a", "ok", "12:00"), ("b", "no_data", "10:00"), ("c", "no_data", "11:00"), ("d", "ok", "12:30")]
    ]
    table = make.frame(rows, ALERT_STATE, workspace_id="ws", rule_id="r1")
    assert alerts.primary_state(table).first()["group_value"] == "c"
    assert [r["group_value"] for r in alerts.by_priority(table, 3).collect()] == ["c", "b", "d"]


def test_rule_validation(rules):
    table = rules(
        {},
        {"rule_id": "name", "name": " "},
        {"rule_id": "window", "window_seconds": 59},
        {"rule_id": "interval", "evaluation_interval_seconds": 86401},
        {"rule_id": "threshold", "threshold": float("nan")},
        {"rule_id": "comparator", "comparator": "above"},
        {"rule_id": "group", "group_by": "a b"},
        {"rule_id": "subject", "subject": "-x"},
        {"rule_id": "metadata", "metadata": {"k": " "}},
        {"rule_id": "defaults", "window_seconds": None, "evaluation_interval_seconds": 0, "comparator": None},
    )
    bad = {r["rule_id"] for r in alerts.validate_rules(table).collect()}
    assert bad == {"name", "window", "interval", "threshold", "comparator", "group", "subject", "metadata"}


def test_store_evaluates_touched_rules(spark, make, rules):
    store = EventStore(spark, scratch_path(spark, "alerts"))
    idle = {"next_evaluate_at": at("2027-01-01")}  # not due: only what a batch touches is evaluated
    meters, table = make.meters(), rules(idle, {**idle, "rule_id": "r2", "subject": "nobody"})
    store.ingest(make.raw({"quantity": 12.0, "timestamp": at("2026-06-08 11:30")}), meters, "b1", NOW)
    store.evaluate_alerts("b1", table, meters, NOW)
    store.evaluate_alerts("b1", table, meters, NOW)
    assert [(r["rule_id"], r["type"]) for r in store.alert_events().collect()] == [("r1", "triggered")]
    later = "2026-06-08T13:00:00Z"
    store.ingest(make.raw({"quantity": 1.0, "timestamp": at("2026-06-08 12:59")}), meters, "b2", later)
    store.evaluate_alerts("b2", table, meters, later)
    types = [r["type"] for r in store.alert_events().orderBy("created_at").collect()]
    assert types == ["triggered", "resolved"]
    assert [(r["rule_id"], r["status"]) for r in store.alert_states().collect()] == [("r1", "ok")]


def test_due_rule_without_usage_resolves(spark, make, rules):
    store = EventStore(spark, scratch_path(spark, "alerts-due"))
    meters = make.meters()
    store.ingest(make.raw({"quantity": 12.0, "timestamp": at("2026-06-08 11:30")}), meters, "b1", NOW)
    store.evaluate_alerts("b1", rules({"next_evaluate_at": at("2026-06-08 13:00")}), meters, NOW)
    later = "2026-06-08T15:00:00Z"
    store.evaluate_alerts("tick-1", rules({"next_evaluate_at": at("2026-06-08 13:00")}), meters, later)
    types = [r["type"] for r in store.alert_events().orderBy("created_at").collect()]
    assert types == ["triggered", "resolved"]
    assert [r["status"] for r in store.alert_states().collect()] == ["no_data"]


def test_grouped_rule_compares_metadata_by_type(spark, make, rules):
    events = usage(make, ("a", 20, "11:30", {"status": 200}), ("b", 30, "11:40", {"status": "200"}))
    table = rules({"group_by": "subject", "metadata": {"status": "200"}}, {"rule_id": "r2", "metadata": {"status": "200"}})
    values = alerts.evaluate(table, events, make.meters(), no_states(spark), NOW).collect()
    found = {(r["rule_id"], r["group_value"]): r["value"] for r in values}
    assert found == {("r1", "b"): 30.0, ("r2", ""): 50.0}


PANE_RULES = (
    {"rule_id": "sum"},
    {"rule_id": "long", "window_seconds": 7 * 86400},
    {"rule_id": "subject", "group_by": "subject", "window_seconds": 7200},
    {"rule_id": "status", "group_by": "metadata.status", "window_seconds": 86400},
    {"rule_id": "strict", "group_by": "subject", "metadata": {"status": "200"}},
    {"rule_id": "text", "metadata": {"status": "200"}},
    {"rule_id": "nested", "group_by": "geo.land", "metadata": {"geo.land": "x y"}},
)
PANE_ROWS = [
    {
        "subject": f"s{i % 3}",
        "quantity": 1.0 + i * 0.25,
        "timestamp": at("2026-06-08 11:59:59") - timedelta(seconds=i * i * 37),
        "metadata": json.dumps(
            {"status": [200, "200", 1.50, None, True][i % 5], "geo": {"land": ["x y", 'q"', 3][i % 3]}, "noise": i}
        ),
    }
    for i in range(120)
]


@pytest.fixture(scope="module")
def pane_store(spark):
    """Two batches that overlap in time; a meter's aggregation only matters at evaluation."""
    return EventStore(spark, scratch_path(spark, "panes"), panes=("status", "geo.land"))


def _filled(store, make):
    if not store.exists("ledger"):
        for part in range(2):
            store.ingest(make.raw(*PANE_ROWS[part::2]), make.meters(), f"b{part}", NOW)
    return store


def _values(rows):
    return sorted((r["rule_id"], r["group_value"], round(r["value"], 6), r["usage_events"]) for r in rows.collect())


def test_panes_give_the_values_of_the_events(spark, make, rules, pane_store, capsys):
    store, table, meters = _filled(pane_store, make), rules(*PANE_RULES), make.meters({"aggregation": "last"})
    from_panes = store.alert_values(table, meters, NOW)
    from_panes.explain("formatted")
    plan = capsys.readouterr().out
    assert "/panes" in plan and "/events" not in plan
    for start in ("2026-06-08T11:00", "2026-06-07T12:00", "2026-06-01T12:00"):  # each class its own range
        assert re.search(rf"PushedFilters: .*GreaterThanOrEqual\(event_time,{start}", plan), start
    expected = _values(alerts.rule_values(alerts.normalize_rules(table), store.events(), meters, NOW))
    assert _values(from_panes) == expected and {r[0] for r in expected} == {r["rule_id"] for r in PANE_RULES}
    store.evaluate_alerts("b1", table, meters, NOW)
    states = store.alert_states().collect()
    assert sorted((r["rule_id"], r["group_value"], round(r["value"], 6)) for r in states) == [r[:3] for r in expected]


def test_rules_that_panes_cannot_answer_read_the_events(spark, make, rules, pane_store):
    store, meters = _filled(pane_store, make), make.meters()
    table = rules(
        {"rule_id": "sum", "window_seconds": 7200},
        {"rule_id": "group", "group_by": "noise"},  # a field that the panes do not hold
        {"rule_id": "metadata", "metadata": {"noise": "1"}},
        {"rule_id": "window", "window_seconds": 90},
    )

    def check(now):
        expected = _values(alerts.rule_values(alerts.normalize_rules(table), store.events(), meters, now))
        assert _values(store.alert_values(table, meters, now)) == expected
        return expected

    full = check(NOW)
    assert {r[0] for r in full} == {"sum", "group", "metadata", "window"}
    check("2026-06-08T12:00:01Z")
    schema = "workspace_id string, meter_name string, cutoff timestamp_ntz"
    for name, cutoff in (("on an edge", "2026-06-08 11:30:00"), ("inside a pane", "2026-06-08 11:40:30")):
        store.prune(spark.createDataFrame([("ws", "api_calls", at(cutoff))], schema), name, NOW)
        assert check(NOW) != full


# --- saved queries and exports ----------------------------------------------------------


def spec_json(**more):
    spec = {"workspace": "ws", "meter": "api_calls", "start": "2026-06-08T00:00:00Z", "end": "2026-06-09T00:00:00Z"}
    return json.dumps({**spec, **more})


def test_exports_run_independently(spark, make, tmp_path):
    events = usage(make, ("a", 2, "10:00", {}), ("b", 3, "11:00", {}))
    specs = [
        ("one", spec_json(group_by="subject", limit=100)),
        ("two", spec_json(meter="unknown")),
        ("three", spec_json(filter={"type": "condition", "field": "quantity", "op": "gt", "value": 2})),
    ]
    status = run_exports(spark, specs, events, make.meters(), str(tmp_path))
    assert {r["id"]: r["status"] for r in status.collect()} == {"one": "completed", "two": "failed", "three": "completed"}
    counts = export_status(status).first()
    assert (counts["active"], counts["completed"], counts["needs_action"]) == (0, 2, 1)
    lines = (tmp_path / "one").glob("part-*.csv").__next__().read_text().splitlines()
    assert lines[1:] == ["2026-06-08T00:00:00Z,a,api_calls,day,sum,call,2", "2026-06-08T00:00:00Z,b,api_calls,day,sum,call,3"]
    assert "call,3" in "".join(p.read_text() for p in (tmp_path / "three").glob("part-*.csv"))


def test_overview_takes_pinned_queries_in_order(spark, make):
    schema = "id string, pinned boolean, position int, updated_at timestamp_ntz, spec string"
    rows = [
        {"id": "c", "pinned": True, "position": 2, "spec": spec_json(kind="aggregate")},
        {"id": "a", "pinned": False, "position": 0, "spec": spec_json()},
        {"id": "b", "pinned": True, "position": 1, "spec": spec_json(kind="breakdown", group_by="subject")},
    ]
    saved = make.frame(rows, schema, updated_at=at("2026-06-08"))
    specs = overview(saved)
    assert [key for key, _ in specs] == ["b", "c"]
    events = usage(make, ("a", 2, "10:00", {}), ("b", 3, "11:00", {}))
    results = run_specs(specs, events, make.meters())
    assert results["c"].first()["quantity"] == 5.0
    assert sorted(r["value"] for r in results["b"].collect()) == ["a", "b"]
    assert isinstance(specs[0][1], QuerySpec)
