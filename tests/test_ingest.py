"""Validation, deduplication, the store and retention."""

import json
from random import Random

import pytest
from pyspark.sql import functions as F

from sample_values import at, dim
from meterframe.operators import catalog, ingest, joins, retention
from meterframe.operators.breakdown import aggregate_range
from meterframe.functions.predicates import Condition
from meterframe.functions.timecalc import ntz
from meterframe.operators.buckets import buckets
from meterframe.schema import RAW_EVENT
from meterframe.session import scratch_path
from meterframe.sources.readers import read_raw_json, stream_raw_json
from meterframe.sources.store import EventStore
from meterframe.streaming.ingest import start_ingest

NOW = "2026-06-08T12:00:00Z"
T = at("2026-06-08 10:00")


@pytest.fixture
def store(spark):
    return EventStore(spark, scratch_path(spark, "store"))


def day_sum(store):
    row = aggregate_range(store.events(), "api_calls", "2026-06-08T00:00:00Z", "2026-06-09T00:00:00Z").first()
    return row["quantity"]


def test_duplicate_key_returns_the_original(make, store):
    meters = make.meters()
    store.ingest(make.raw({"idempotency_key": "usage-1", "quantity": 2.0, "timestamp": T}), meters, "b1", NOW)
    got = store.ingest(
        make.raw(
            {"idempotency_key": "usage-1", "quantity": 100.0, "timestamp": T},
            {"idempotency_key": " usage-2 ", "quantity": 3.0, "timestamp": T},
        ),
        meters,
        "b2",
        NOW,
    )
    assert [(r["idempotency_key"], r["quantity"]) for r in got.accepted.collect()] == [("usage-2", 3.0)]
    assert [(r["index"], r["quantity"]) for r in got.duplicates.collect()] == [(0, 2.0)]
    assert day_sum(store) == 5.0
    runs = {r["id"]: (r["accepted"], r["duplicates"], r["failed"]) for r in store.runs().collect()}
    assert runs == {"b1/ws": (1, 0, 0), "b2/ws": (1, 1, 0)}


def test_batch_replay_ignores_the_new_payload(make, store):
    meters = make.meters()
    first = make.raw(
        {"idempotency_key": "a", "quantity": 2.0, "timestamp": T}, {"idempotency_key": "b", "quantity": 3.0, "timestamp": T}
    )
    store.ingest(first, meters, "batch-1", NOW)
    replay = make.raw({"idempotency_key": "a", "quantity": 100.0, "timestamp": T}, {"meter": "unknown", "timestamp": T})
    got = store.ingest(replay, meters, "batch-1", NOW)
    assert got.replayed
    assert sorted(r["quantity"] for r in got.accepted.collect()) == [2.0, 3.0]
    assert [(r["index"], r["code"]) for r in got.failed.collect()] == [(1, "not_found")]
    assert day_sum(store) == 5.0


def test_failed_rows_do_not_block_others(make, store):
    raw = make.raw({"meter": "unknown", "quantity": 9.0, "timestamp": T}, {"quantity": 3.0, "timestamp": T})
    got = store.ingest(raw, make.meters(), "b1", NOW)
    assert [(r["index"], r["code"]) for r in got.failed.collect()] == [(0, "not_found")]
    assert day_sum(store) == 3.0


def test_half_written_batch_can_run_again(make, store):
    """The events of an uncommitted batch are invisible and are replaced by the rerun."""
    meters = make.meters()
    raw = make.raw({"idempotency_key": "a", "quantity": 2.0, "timestamp": T})
    store.ingest(raw, meters, "b0", NOW)
    write = store.write

    def fail_on_ledger(table, rows, batch_id):
        if table == "ledger":
            raise RuntimeError("stopped")
        write(table, rows, batch_id)

    again = make.raw({"idempotency_key": "c", "quantity": 4.0, "timestamp": T})
    store.write = fail_on_ledger
    with pytest.raises(RuntimeError):
        store.ingest(again, meters, "b1", NOW)
    store.write = write
    assert day_sum(store) == 2.0
    got = store.ingest(again, meters, "b1", NOW)
    assert [r["quantity"] for r in got.accepted.collect()] == [4.0]
    assert got.duplicates.count() == 0
    assert day_sum(store) == 6.0


def test_dimension_checks(make):
    meters = make.meters(
        {"dimensions": [dim("region", required=True), dim("status", "number"), dim("old", required=True, deprecated=True)]}
    )
    payloads = [
        {"status": 200},
        {"region": "eu", "status": "200"},
        {"region": "eu", "status": 201.5, "trace_id": "x"},
        {"region": None},
        {"region": True},
    ]
    raw = make.raw(*[{"metadata": json.dumps(p), "timestamp": T} for p in payloads], {"metadata": "[1]", "timestamp": T})
    rows = ingest.validate(raw, meters, NOW).orderBy("index").collect()
    assert [r["message"] for r in rows] == [
        'dimension "region" is required',
        'dimension "status" must be number',
        None,
        'dimension "region" must be string',
        'dimension "region" must be string',
        "metadata must be a JSON object",
    ]
    assert json.loads(rows[2]["metadata"])["trace_id"] == "x"


def test_dotted_keys_become_nested(make):
    meters = make.meters({"dimensions": [dim("service.tier", required=True)]})
    payloads = [
        {"service.tier": "gold", "x": 1},
        {"service": {"tier": "silver", "zone": 2}},
        {"service.tier": "gold", "service": {"zone": 2}},
        {"service.tier": "gold", "service": "plain"},
        {"service": {}},
    ]
    raw = make.raw(*[{"metadata": json.dumps(p), "timestamp": T} for p in payloads])
    rows = ingest.validate(raw, meters, NOW).orderBy("index").collect()
    assert [json.loads(r["metadata"]) for r in rows[:3]] == [
        {"x": 1, "service": {"tier": "gold"}},
        {"service": {"tier": "silver", "zone": 2}},
        {"service": {"zone": 2, "tier": "gold"}},
    ]
    assert [r["message"] for r in rows[3:]] == [
        'dimension "service.tier" conflicts with existing metadata',
        'dimension "service.tier" is required',
    ]


def _nested_by_hand(data: dict, names: list[str]) -> tuple[dict, str | None]:
    result = json.loads(json.dumps(data))
    for name in names:
        if name not in result:
            continue
        *parents, leaf = name.split(".")
        node = result
        for part in parents:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                return data, f'dimension "{name}" conflicts with existing metadata'
        node[leaf] = result.pop(name)
    return result, None


def test_dotted_keys_equal_a_plain_version(spark):
    random, names = Random(3), ["a.b", "a.b.c", "a.d", "e.f.g.h", "a.b"]
    values = [1, -2.5, "x", 'q"\\u00e9', True, None, [1, {"z": "2"}], {"c": 3}, {}, {"b": {"c": 1}, "y": None}]
    docs = [
        {key: random.choice(values) for key in random.sample(["a.b", "a.b.c", "a.d", "e.f.g.h", "a", "e", "other", "x.y"], random.randrange(6))}
        for _ in range(400)
    ]
    rows = spark.createDataFrame([(i, json.dumps(d), names) for i, d in enumerate(docs)], "i int, metadata string, names array<string>")
    found = rows.select("i", ingest.nest_dotted_keys(F.col("metadata"), F.col("names"), 4).alias("n")).select("i", "n.*").collect()
    conflicts = 0
    for row in found:
        expected, error = _nested_by_hand(docs[row["i"]], names)
        assert (json.loads(row["metadata"]), row["error"]) == (expected, error), docs[row["i"]]
        conflicts += error is not None
    assert 20 < conflicts < 380


def test_dotted_keys_need_no_python_worker(make, capsys):
    meters = make.meters({"dimensions": [dim("service.tier")]})
    ingest.validate(make.raw({"metadata": "{}", "timestamp": T}), meters, NOW).explain()
    assert "Python" not in capsys.readouterr().out


def test_subjects_and_quantities(make):
    good = ["org_123", "customer-42", "acct.abc", "tenant:west"]
    bad = ["", "org 123", "org/123", "gggg-<>ddddd", "-org", "a" * 129]
    rows = [{"subject": s, "timestamp": T} for s in good + bad]
    rows += [{"quantity": q, "timestamp": T} for q in (0.0, -1.0, float("nan"), None)]
    rows += [{"meter": "  ", "timestamp": T}, {"meter": None, "timestamp": T}]
    got = ingest.validate(make.raw(*rows), make.meters(), NOW).orderBy("index").collect()
    assert [r["code"] for r in got] == [None] * 4 + ["invalid_input"] * 12


def test_event_time_defaults_to_now(make):
    row = ingest.validate(make.raw({}), make.meters(), NOW).first()
    assert row["event_time"] == at("2026-06-08 12:00")


def test_rows_without_a_key_never_deduplicate(make):
    raw = make.raw(*[{"idempotency_key": k, "timestamp": T} for k in (None, "", " ", "k", "k", "k")])
    ok = ingest.valid_rows(ingest.validate(raw, make.meters(), NOW))
    assert sorted(r["index"] for r in ingest.dedupe_batch(ok).collect()) == [0, 1, 2, 3]


def test_conflicting_ids(make, store):
    meters = make.meters()
    store.ingest(make.raw({"id": "x", "timestamp": T}), meters, "b1", NOW)
    with pytest.raises(ValueError):
        store.ingest(make.raw({"id": "x", "timestamp": T}), meters, "b2", NOW, reject_known_ids=True)


def test_promoted_dimension_is_read_without_the_metadata(spark, make, capsys):
    store = EventStore(spark, scratch_path(spark, "promoted"), promote=("service.tier",))
    rows = [{"metadata": json.dumps({"service": {"tier": t}}), "timestamp": T, "quantity": q} for t, q in (("a", 1.0), ("b", 2.0), ("a", 4.0))]
    store.ingest(make.raw(*rows, {"timestamp": T}), make.meters(), "b1", NOW)
    got = buckets(
        store.events(), "api_calls", "2026-06-08T00:00:00Z", "2026-06-09T00:00:00Z", workspace="ws", group_by="service.tier"
    )
    assert sorted((r["service_tier"], r["quantity"]) for r in got.collect()) == [("<nil>", 1.0), ("a", 5.0), ("b", 2.0)]
    got.explain("formatted")
    plan = capsys.readouterr().out
    scan = next(line for line in plan.splitlines() if line.startswith("ReadSchema") and "quantity" in line)
    assert "dim_service.tier" in scan and "metadata" not in scan
    assert "PartitionFilters: [isnotnull(event_date" in plan
    # A text filter on the dimension needs no metadata either; a typed one still tells text from other types.
    day = ("2026-06-08T00:00:00Z", "2026-06-09T00:00:00Z")
    for test in (
        {"filter": Condition("metadata.service.tier", "contains", "a")},
        {"metadata": {"service.tier": "a"}},
        {"filter": Condition("metadata.service.tier", "eq", "a")},
    ):
        filtered = buckets(store.events(), "api_calls", *day, workspace="ws", **test)
        assert [r["quantity"] for r in filtered.collect()] == [5.0]
        filtered.explain("formatted")
        plan = capsys.readouterr().out
        scan = next(line for line in plan.splitlines() if line.startswith("ReadSchema") and "quantity" in line)
        typed = "filter" in test and test["filter"].op == "eq"
        assert "dim_service.tier" in scan and ("metadata" in scan) == typed


def test_any_split_gives_the_same_store(spark, make):
    """Events ingested at once or in random batches: same events, same counters."""
    random = Random(3)
    meters = make.meters({}, {"name": "storage"})
    assignments = make.assignments({"assigned_at": at("2026-05-31 15:30")})
    rows = [
        {
            "index": i,
            "id": f"e{i:03d}",
            "idempotency_key": f"k{random.randrange(30)}" if random.random() < 0.8 else None,
            "meter": random.choice(["api_calls", "storage"]),
            "quantity": float(random.randrange(1, 50)),
            "timestamp": at("2026-06-01 00:00").replace(day=random.randrange(1, 28), hour=random.randrange(24)),
        }
        for i in range(60)
    ]

    def load(parts):
        store = EventStore(spark, scratch_path(spark, "split"))
        for n, part in enumerate(parts):
            store.ingest(make.raw(*part), meters, f"b{n}", NOW, assignments=assignments)
        events = sorted(r["id"] for r in store.events().collect())
        counters = sorted(
            (r["meter_name"], r["period"], r["period_start"], r["event_count"], r["quantity_sum"], r["last_event"]["id"])
            for r in store.counters().collect()
        )
        return events, counters, store

    whole = load([rows])
    cut = random.randrange(10, 40)
    split = load([rows[:cut], rows[cut:50], rows[50:]])
    assert whole[:2] == split[:2]

    store = split[2]
    got = store.ingest(make.raw(*rows), meters, "b9", NOW, assignments=assignments)
    keyless = sum(r["idempotency_key"] is None for r in rows)
    assert got.accepted.count() == keyless
    replay = store.ingest(make.raw(*rows[:cut]), meters, "b0", NOW)
    assert replay.replayed and replay.accepted.count() > 0


def test_hot_keys_take_the_salted_join(spark, make):
    """The shuffled join with salted hot keys gives the rows of the plain join."""
    facts = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))).alias("subject"),
    )
    side = facts.select("subject").distinct().withColumn("value", F.hash("subject")).filter("subject <> 's5'")
    for how in ("inner", "left"):
        plain = facts.join(side, "subject", how).select("id", "subject", "value")
        salted = joins.side_join(facts, side, ["subject"], how, max_rows=10).select("id", "subject", "value")
        assert "__salt" in salted._jdf.queryExecution().toString()
        assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_duplicates_of_a_hot_key(spark, make):
    rows = [{"idempotency_key": "hot" if i % 3 else f"k{i}", "timestamp": T, "quantity": float(i + 1)} for i in range(300)]
    ok = ingest.valid_rows(ingest.validate(make.raw(*rows), make.meters(), NOW))
    firsts = ingest.dedupe_batch(ok)
    got = ingest.duplicates(ok, firsts, make.usage().filter("false")).collect()
    assert len(got) == 199
    assert {(r["idempotency_key"], r["quantity"]) for r in got} == {("hot", 2.0)}


# --- retention ---------------------------------------------------------------------


def test_prune_is_strict_and_keeps_keys(make, store):
    meters = make.meters({"event_retention_days": 1}, {"name": "storage", "event_retention_days": 90})
    raw = make.raw(
        {"timestamp": at("2026-06-08 23:59:59"), "idempotency_key": "old"},
        {"timestamp": at("2026-06-09 00:00:00"), "quantity": 2.0},
        {"timestamp": at("2026-06-07 10:00:00")},
        {"timestamp": at("2026-06-07 11:00:00"), "meter": "storage", "quantity": 5.0},
    )
    store.ingest(raw, meters, "b1", NOW)
    cuts = retention.cutoffs(meters, "2026-06-10T00:00:00Z")
    counts = retention.prunable_counts(store.events(), cuts)
    assert {r["meter_name"]: r["deleted"] for r in counts.collect()} == {"api_calls": 2, "storage": 0}
    run = retention.prune_run(counts, True, "r1", "2026-06-10T00:00:00Z").first()
    assert (run["deleted"], run["dry_run"], len(run["meters"])) == (2, True, 2)
    assert store.events().count() == 4
    before, later = store.events(), "2026-06-10T00:00:00Z"
    store.write("cutoffs", cuts.withColumn("pruned_at", ntz(later)), "stopped")  # a prune that ended before its entry
    assert store.events().count() == 4
    store.prune(cuts, "p1", later)
    assert sorted(r["quantity"] for r in store.events().collect()) == [2.0, 5.0]
    assert before.count() == 4  # a reader that began earlier sees all events
    assert len(store.sweep()) == 1
    assert sorted(r["quantity"] for r in store.events().collect()) == [2.0, 5.0]
    again = make.raw({"timestamp": at("2026-06-09 10:00:00"), "idempotency_key": "old"})
    assert store.ingest(again, meters, "b2", NOW).accepted.count() == 0
    assert store.sweep() == []
    # What comes after the prune is new, however old.
    late = make.raw({"timestamp": at("2026-06-01"), "quantity": 7.0})
    store.ingest(late, meters, "b3", "2026-06-11T00:00:00Z")
    assert sorted(r["quantity"] for r in store.events().collect()) == [2.0, 5.0, 7.0]


# --- catalog -----------------------------------------------------------------------


def test_dimension_names(make):
    names = ["region-name", "service.tier", "status_code", "region name", "region/name", ".region", "region.", "region..name", "subject"]
    meters = make.meters(*[{"name": n, "dimensions": [dim(n)]} for n in names])
    bad = {r["name"] for r in catalog.validate_meters(meters).collect()}
    assert bad == set(names[3:])


def test_defaults(make):
    meters = make.meters({"aggregation": "", "event_retention_days": 0, "dimensions": [("service.tier", "", "", "string", None, None)]})
    row = catalog.normalize_meters(meters).first()
    assert (row["aggregation"], row["event_retention_days"]) == ("sum", 90)
    assert row["dimensions"][0]["display_name"] == "Service Tier"


def test_evolution(make):
    old = make.meters({"dimensions": [dim("region"), dim("plan")]}, {"name": "unused", "dimensions": [dim("x")]})
    used = make.frame([{}], "workspace_id string, meter_name string", workspace_id="ws", meter_name="api_calls")

    def messages(*dimensions):
        new = make.meters({"dimensions": list(dimensions)}, {"name": "unused", "dimensions": []})
        return sorted((r["dimension"], r["message"].split(" after")[0]) for r in catalog.check_evolution(old, new, used).collect())

    assert messages(dim("region")) == [("plan", "cannot be removed")]
    assert messages(dim("region", "number"), dim("plan")) == [("region", "type cannot change")]
    assert messages(dim("region", required=True), dim("plan")) == [("region", "cannot become required")]
    assert messages(dim("region"), dim("plan"), dim("n", required=True)) == [("n", "cannot be added")]
    assert messages(dim("region"), dim("plan"), dim("n"), dim("o", required=True, deprecated=True)) == []


def test_upsert_keeps_the_newest(make):
    schema = "id string, value int, updated_at int"
    table = make.frame([{"id": "a", "value": 1, "updated_at": 1}, {"id": "b", "value": 2, "updated_at": 5}], schema)
    rows = make.frame([{"id": "a", "value": 9, "updated_at": 1}, {"id": "b", "value": 8, "updated_at": 4}], schema)
    got = {r["id"]: r["value"] for r in catalog.upsert(table, rows, ["id"], "updated_at").collect()}
    assert got == {"a": 9, "b": 2}


# --- sources and stream ---------------------------------------------------------------


def test_json_source(spark, tmp_path):
    rows = [
        {"index": 0, "subject": "org_1", "meter": "api_calls", "quantity": 2, "timestamp": "2026-06-08T12:30:00.25+02:00", "metadata": {"a": {"b": 1}}},
        {"index": 1, "subject": "org_1", "meter": "api_calls", "quantity": 1.5},
    ]
    (tmp_path / "batch.json").write_text(json.dumps(rows))
    got = read_raw_json(spark, str(tmp_path / "batch.json"), multi_line=True).orderBy("index").collect()
    assert got[0]["timestamp"] == at("2026-06-08 10:30:00.25")
    assert json.loads(got[0]["metadata"]) == {"a": {"b": 1}}
    assert got[1]["timestamp"] is None and got[1]["quantity"] == 1.5


def test_stream_equals_batch_and_restarts_cleanly(spark, make, store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def drop(name, *rows):
        text = "\n".join(json.dumps({"workspace_id": "ws", "subject": "org_1", "meter": "api_calls", **r}) for r in rows)
        (source / name).write_text(text + "\n")

    def drain():
        raw = stream_raw_json(spark, str(source), max_files=1)
        start_ingest(store, raw, make.meters(), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r["quantity"] for r in store.events().collect())

    drop("a.json", {"index": 0, "idempotency_key": "k1", "quantity": 1, "timestamp": "2026-06-08T10:00:00Z"})
    drop("b.json", {"index": 0, "idempotency_key": "k1", "quantity": 7}, {"index": 1, "idempotency_key": "k2", "quantity": 2})
    assert drain() == [1.0, 2.0]
    assert drain() == [1.0, 2.0]
    # A late event is accepted without bound.
    drop("c.json", {"index": 0, "idempotency_key": "k3", "quantity": 3, "timestamp": "2020-01-01T00:00:00Z"})
    assert drain() == [1.0, 2.0, 3.0]
    kinds = {(r["kind"], r["accepted"], r["duplicates"]) for r in store.runs().collect()}
    assert kinds == {("stream", 1, 0), ("stream", 1, 1)}


def test_raw_schema_matches_the_reader(spark):
    assert spark.createDataFrame([], RAW_EVENT).columns[0] == "index"
