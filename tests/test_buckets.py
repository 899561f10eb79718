"""Keys and current states in hash buckets: only touched buckets are read, and states equal a fold of the log."""

import re

from pyspark.sql import functions as F
from sample_values import at

from meterframe.operators import entitlements as ent
from meterframe.operators.joins import latest_by
from meterframe.session import scratch_path
from meterframe.sources import store as stores
from meterframe.sources.store import EventStore

NOW = "2026-06-10T00:00:00Z"


def folders(frame, column):
    return {int(re.search(rf"{column}=(\d+)", f)[1]) for f in frame.inputFiles()}


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, make):
    store, meters = EventStore(spark, scratch_path(spark, "keys")), make.meters()
    many = [{"idempotency_key": f"k{i}", "timestamp": at("2026-06-08")} for i in range(300)]
    store.ingest(make.raw(*many), meters, "b1", NOW)
    few = make.raw({"idempotency_key": "k7", "timestamp": at("2026-06-09")}, {"idempotency_key": "new", "timestamp": at("2026-06-09")})
    result = store.ingest(few, meters, "b2", NOW)
    assert [r["idempotency_key"] for r in result.duplicates.collect()] == ["k7"]
    assert [r["idempotency_key"] for r in result.accepted.collect()] == ["new"]
    numbers = store.touched("keys", store.own("firsts", "b2"))
    assert 1 <= len(numbers) <= 2
    assert folders(store.buckets("keys", numbers), "key_bucket") == set(numbers)
    assert len(folders(store.raw_table("keys"), "key_bucket")) > stores.KEY_BUCKETS // 2
    assert store.buckets("keys", []).isEmpty()


def test_states_in_buckets_equal_a_fold_of_the_log(spark, make):
    store, meters, limits = EventStore(spark, scratch_path(spark, "states")), make.meters(), make.limits({})
    assignments = make.assignments(*[{"subject": f"s{i}", "assigned_at": at("2026-06-01")} for i in range(12)])
    # Each batch uses up more of some subjects' quota; a later batch leaves others alone.
    for day, subjects in ((2, range(12)), (3, range(0, 12, 2)), (4, [0, 1])):
        raw = make.raw(*[{"subject": f"s{i}", "quantity": 4.0, "timestamp": at(f"2026-06-0{day}")} for i in subjects])
        now = f"2026-06-0{day}T12:00:00Z"
        store.ingest(raw, meters, f"b{day}", now, assignments=assignments)
        store.evaluate_quotas(f"b{day}", assignments, limits, meters, now)
        if day == 4:  # a batch that runs again replaces its own version
            store.evaluate_quotas(f"b{day}", assignments, limits, meters, now)
    log = store.table("quota_evaluations")
    folded = latest_by(ent.states(log), ent.STATE_KEY, ["evaluated_at"])
    found = store.quota_states()
    assert found.count() == 12
    assert found.exceptAll(folded.select(*found.columns)).isEmpty()
    used = {r["subject"]: r["current"] for r in found.collect()}
    assert (used["s0"], used["s1"], used["s2"], used["s5"]) == (12.0, 8.0, 8.0, 4.0)


def test_old_versions_go_and_uncommitted_ones_do_not_count(spark, make):
    store, meters, limits = EventStore(spark, scratch_path(spark, "heads")), make.meters(), make.limits({})
    assignments = make.assignments({"assigned_at": at("2026-06-01")})
    for day in range(2, 6):
        now = f"2026-06-0{day}T12:00:00Z"
        raw = make.raw({"quantity": 1.0, "timestamp": at(f"2026-06-0{day}")})
        store.ingest(raw, meters, f"b{day}", now, assignments=assignments)
        store.evaluate_quotas(f"b{day}", assignments, limits, meters, now)
    heads = {r["head"] for r in store.raw_table("quota_current").select("head").distinct().collect()}
    assert len(heads) <= stores.KEPT_HEADS + 1 and any(h.endswith("~b5") for h in heads)
    # What a batch without a ledger entry wrote is not seen, and the next version goes beyond it.
    number = store.touched("quota_current", assignments.select("workspace_id", "subject"))[0]
    wrong = store.raw_table("quota_current").drop("head", "state_bucket").limit(1).withColumn("current", F.lit(99.0))
    store.put("quota_current", wrong.withColumns({"state_bucket": F.lit(number), "head": F.lit("000000000099~lost")}))
    assert [r["current"] for r in store.quota_states().collect()] == [4.0]
    store.evaluate_quotas("b5", assignments, limits, meters, "2026-06-06T12:00:00Z")
    newest = store.raw_table("quota_current").agg(F.max("head")).first()[0]
    assert newest == "000000000100~b5"
    assert [r["current"] for r in store.quota_states().collect()] == [4.0]


def test_a_page_reads_the_newest_days_that_fill_it(spark, make, capsys):
    store, meters = EventStore(spark, scratch_path(spark, "pages")), make.meters()
    many = [{"id": f"e{i:03d}", "timestamp": at(f"2026-06-{1 + i % 20:02d}")} for i in range(100)]
    store.ingest(make.raw(*many), meters, "b1", "2026-06-30T00:00:00Z")
    first = store.event_page(12, workspace="ws")
    assert len(first.collect()) == 13
    first.explain()
    filters = re.findall(r"PartitionFilters: \[[^\]]*\]", capsys.readouterr().out)
    assert any("event_date" in f and "2026-06-17" in f and "2026-06-20" in f for f in filters)
    rows = first.collect()[:12]
    cursor = (rows[-1]["event_time"], rows[-1]["id"])
    every = store.event_page(200, cursor, workspace="ws").collect()
    assert len(every) == 88 and (every[0]["event_time"], every[0]["id"]) < cursor
    assert store.event_page(5, workspace="nobody").collect() == []
