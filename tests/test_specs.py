"""Many saved specs from one scan give what each gives alone."""

import json

import pytest
from sample_values import at, dim

from meterframe.operators.exports import run_exports
from meterframe.plans.spec import QuerySpec, named_groups, run_spec, run_together
from meterframe.session import materialize, scratch_path

RANGE = {"workspace": "ws", "start": "2026-06-01T00:00:00Z", "end": "2026-07-01T00:00:00Z"}
SPECS = {
    "plain": {"meter": "api_calls"},
    "grouped": {"meter": "api_calls", "bucket_size": "hour", "group_by": ["region", "subject"]},
    "limited": {"meter": "api_calls", "group_by": "subject", "limit": 3},
    "typed": {"meter": "api_calls", "filter": {"type": "condition", "field": "metadata.code", "op": "eq", "value": 200}},
    "rate": {"meter": "seen", "bucket_size": "month"},
    "one": {"meter": "seen", "subject": "s1", "start": "2026-06-02T00:00:00Z"},
}


@pytest.fixture
def tables(make):
    rows = [
        {
            "event_time": at(f"2026-06-0{1 + i % 4} 0{i % 3}:00"),
            "subject": f"s{i % 3}",
            "meter_name": "seen" if i % 5 == 0 else "api_calls",
            "quantity": float(i),
            "metadata": json.dumps({"region": "eu", "code": 200 if i % 2 else "200"} if i % 4 else {}),
        }
        for i in range(1, 60)
    ]
    rows.append({**rows[0], "workspace_id": "other", "quantity": 1e6})
    dims = {"dimensions": [dim("region"), dim("code")]}
    return materialize(make.usage(*rows), "usage"), make.meters(dims, {**dims, "name": "seen", "aggregation": "rate"})


def test_together_equals_alone(tables, capsys):
    events, meters = tables
    specs = [(key, QuerySpec.from_json(json.dumps({**RANGE, **spec}))) for key, spec in SPECS.items()]
    together = run_together(specs, events, meters)
    found = together.collect()
    assert {r["spec"] for r in found} == set(SPECS)
    for key, spec in specs:
        own = named_groups(together.filter(together["spec"] == key), spec)
        alone = run_spec(spec, events, meters)
        assert own.columns == alone.columns
        assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str), key
    run_together(specs[:2] + specs[3:], events, meters).explain("formatted")
    assert capsys.readouterr().out.count("Scan parquet") == 2  # the tree and the details name the one scan


def test_no_spec_and_wrong_specs(tables):
    events, meters = tables
    assert run_together([], events, meters).collect() == []
    for wrong in ({"meter": "none"}, {"meter": "seen", "kind": "breakdown"}, {"meter": "seen", "group_by": ["plan"]}):
        with pytest.raises((LookupError, ValueError)):
            run_together([("x", QuerySpec.from_json(json.dumps({**RANGE, **wrong})))], events, meters)


def test_a_batch_of_exports_read_back(spark, tables):
    events, meters = tables
    folder = scratch_path(spark, "exports")
    texts = [(key, json.dumps({**RANGE, **spec})) for key, spec in SPECS.items()]
    status = run_exports(spark, [*texts, ("bad", "{"), ("lost", json.dumps({**RANGE, "meter": "none"}))], events, meters, folder)
    states = {r["id"]: r["status"] for r in status.collect()}
    assert states == {**dict.fromkeys(SPECS, "completed"), "bad": "failed", "lost": "failed"}
    back = spark.read.option("header", True).csv(f"{folder}/grouped")
    spec = QuerySpec.from_json(texts[1][1])
    alone = run_spec(spec, events, meters)
    want = sorted((r["subject"], r["region"], r["quantity"]) for r in alone.collect())
    assert sorted((r["subject"], r["region"], float(r["quantity"])) for r in back.collect()) == want
