"""Cases outside the driver's tables: missing index, bad times, keyless rows, overlapping history."""

import json

import pytest
from sample_values import at
from pyspark.sql import functions as F

from meterframe.functions.predicates import value_text
from meterframe.operators.buckets import group_fields
from meterframe.operators.entitlements import with_assignment
from meterframe.operators.ingest import validate
from meterframe.operators.scan import scan
from meterframe.session import scratch_path
from meterframe.sources.readers import read_raw_json, stream_parquet
from meterframe.sources.sinks import event_csv, plain_number
from meterframe.sources.store import EventStore
from meterframe.streaming.ingest import drop_repeats_within
from meterframe.streaming.windows import with_open_windows

NOW = "2026-06-08T12:00:00Z"


def written(spark, rows, name):
    path = scratch_path(spark, name)
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_json_rows_without_index_get_their_own_ids(spark, make):
    rows = [{"workspace_id": "ws", "subject": "s", "meter": "api_calls", "quantity": 1.0 + n} for n in range(5)]
    raw = read_raw_json(spark, written(spark, rows, "no-index"))
    checked = validate(raw, make.meters(), NOW, "b").collect()
    assert [r["message"] for r in checked] == [None] * 5
    assert len({r["id"] for r in checked}) == 5
    assert sorted(r["index"] for r in checked) == [0, 1, 2, 3, 4]


def test_unreadable_time_is_a_failed_row(spark, make):
    base = {"workspace_id": "ws", "subject": "s", "meter": "api_calls", "quantity": 1.0}
    rows = [{**base, "timestamp": t} for t in ("not-a-time", "", "2026-06-08T10:00:00+02:00")] + [base]
    raw = read_raw_json(spark, written(spark, rows, "times"))
    checked = {r["index"]: (r["code"], r["event_time"]) for r in validate(raw, make.meters(), NOW, "b").collect()}
    assert checked[0][0] == "invalid_input"
    assert checked[1] == checked[3] == (None, at("2026-06-08 12:00"))
    assert checked[2] == (None, at("2026-06-08 08:00"))


def test_same_id_and_key_twice_is_a_duplicate(spark, make):
    store = EventStore(spark, scratch_path(spark, "same-id"))
    row = {"id": "x", "idempotency_key": "k", "quantity": 2.0, "timestamp": at("2026-06-08 10:00")}
    got = store.ingest(make.raw(row, row), make.meters(), "b1", NOW)
    assert (got.accepted.count(), got.duplicates.count()) == (1, 1)


def test_batch_ids_of_two_tenants_do_not_meet(spark, make):
    store = EventStore(spark, scratch_path(spark, "tenants"))
    meters = make.meters({}, {"workspace_id": "ws2"})
    for tenant in ("ws", "ws2"):
        raw = make.raw({"workspace_id": tenant, "idempotency_key": "k", "timestamp": at("2026-06-08 10:00")})
        got = store.ingest(raw, meters, "batch-1", NOW, workspace=tenant)
        assert not got.replayed and got.accepted.count() == 1
    assert store.ingest(raw, meters, "batch-1", NOW, workspace="ws2").replayed
    assert sorted(r["workspace_id"] for r in store.events().collect()) == ["ws", "ws2"]


def test_stream_keeps_events_without_a_key(spark, make):
    path = scratch_path(spark, "keyless")
    keys = ["a", "a", None, None, None]
    events = make.usage(*[{"idempotency_key": k, "quantity": 1.0, "event_time": at("2026-06-08 10:00")} for k in keys])
    events.write.parquet(path)
    kept = drop_repeats_within(stream_parquet(spark, path, events.schema), "1 day")
    query = kept.writeStream.format("memory").queryName("keyless").trigger(availableNow=True)
    query.option("checkpointLocation", scratch_path(spark, "keyless-checkpoint")).start().awaitTermination()
    assert spark.table("keyless").count() == 4


@pytest.mark.parametrize(
    "value, text",
    [
        (9.0, "9"), (2.5, "2.5"), (0.000001, "0.000001"), (1.5e-18, "0.0000000000000000015"), (1e-20, "0." + "0" * 19 + "1"),
        (1e22, "1" + "0" * 22), (-1.25e7, "-12500000"), (1234567.125, "1234567.125"), (0.0, "0"), (123456789.5, "123456789.5"),
        (1.23456789e-15, "0.00000000000000123456789"), (0.1, "0.1"), (100.0, "100"), (-0.5, "-0.5"),
    ],
)
def test_numbers_keep_all_digits(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(plain_number(F.col("v"))).first()[0] == text


def test_text_of_filter_numbers():
    shown = {1234567.0: "1.234567e+06", 0.123456789: "0.123456789", 100000.0: "100000", 0.00001: "1e-05", 2.5: "2.5", -0.0: "-0"}
    assert {v: value_text(v) for v in shown} == shown


def test_broken_metadata_is_exported_as_stored(spark, make):
    events = make.usage({"quantity": 1.0, "event_time": at("2026-06-08 10:00"), "metadata": "{broken"})
    assert event_csv(events).first()["metadata"] == "{broken"


def test_older_plan_comes_back(spark, make):
    rows = [
        ("a", "ws", "s", "A", at("2026-01-01"), at("2026-01-01"), None, at("2026-01-01")),
        ("b", "ws", "s", "B", at("2026-01-05"), at("2026-01-05"), at("2026-01-07"), at("2026-01-05")),
        ("c", "ws", "t", "A", at("2026-01-01"), at("2026-01-01"), at("2026-01-06"), at("2026-01-01")),
        ("d", "ws", "t", "B", at("2026-01-05"), at("2026-01-05"), None, at("2026-01-05")),
    ]
    assignments = spark.createDataFrame(
        rows,
        "id string, workspace_id string, subject string, plan_id string, assigned_at timestamp_ntz, "
        "period_anchor_at timestamp_ntz, unassigned_at timestamp_ntz, updated_at timestamp_ntz",
    )
    days = [2, 5, 6, 7, 8]
    events = make.usage(*[{"subject": s, "quantity": 1.0, "event_time": at(f"2026-01-0{d}")} for s in "st" for d in days])
    found = {(r["subject"], r["event_time"].day): r["plan_id"] for r in with_assignment(events, assignments, "left").collect()}
    assert [found["s", d] for d in days] == ["A", "B", "B", "A", "A"]
    assert [found["t", d] for d in days] == ["A", "B", "B", "B", "B"]


def test_allow_list_without_a_workspace(spark, make):
    events = make.usage(*[{"meter_name": m, "quantity": 1.0, "event_time": at("2026-06-08 10:00")} for m in ("view", "click")])
    assert [r["meter_name"] for r in scan(events, allowed_meters=("view",)).collect()] == ["view"]


def test_any_number_of_group_fields():
    assert len(group_fields([f"f{n}" for n in range(9)])) == 9


def test_open_windows_join_the_closed_ones(spark):
    """A window comes once, from the standing query if it has emitted it; a missing group value is a key too."""
    schema = "bucket_start int, k string, quantity double"
    closed = spark.createDataFrame([(1, None, 5.0), (1, "a", 2.0)], schema)
    every = spark.createDataFrame([(1, None, 6.0), (1, "a", 2.0), (2, None, 1.0), (2, "a", 3.0)], schema)
    got = with_open_windows(closed, every, ["bucket_start", "k"]).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a", 2.0), (1, None, 5.0), (2, "a", 3.0), (2, None, 1.0)]
