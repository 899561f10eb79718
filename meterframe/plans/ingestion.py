"""Registered ingest, retention, catalog and export-status queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz
from meterframe.operators import catalog, exports, ingest, retention, stats
from meterframe.plans.alerting import rules
from meterframe.plans.registry import EV, MET, ctes, query
from meterframe.schema import EVENT_COLUMNS
from meterframe.session import materialize, scratch_path
from meterframe.sources.readers import read_raw_json
from meterframe.sources.store import EventStore
from meterframe.sources.tables import event_meters, raw_from_usage, table, usage_from_events

NOW = "2024-02-01T00:00:00Z"
SPLIT = "2024-01-16T00:30:00Z"

# The raw stream carries faults that follow from the values: `error` events name a
# meter that does not exist, small quantities become 0, large `view` events lose their
# dimension and large `click` events carry it as a string, and some `purchase` events
# have a subject outside the grammar.


def faulty_raw(usage: DataFrame) -> DataFrame:
    raw = raw_from_usage(usage)
    meter, quantity = F.col("meter"), F.col("quantity")
    as_text = F.regexp_replace("metadata", r"(\d+)", '"$1"')
    return raw.withColumns(
        {
            "meter": F.when(meter == "error", "outage").otherwise(meter),
            "quantity": F.when(quantity < 1, 0.0).otherwise(quantity),
            "metadata": F.when((meter == "view") & (quantity > 80), "{}")
            .when((meter == "click") & (quantity > 70), as_text)
            .otherwise(F.col("metadata")),
            "subject": F.when((meter == "purchase") & (quantity > 100), F.concat(F.lit("-"), "subject")).otherwise(
                F.concat(F.lit(" "), "subject")
            ),
        }
    )


RAW = """raw AS (SELECT CAST(id AS BIGINT) AS index, id, workspace_id, idempotency_key,
  CASE WHEN meter_name = 'purchase' AND quantity > 100 THEN '-' || subject ELSE subject END AS subject,
  CASE WHEN meter_name = 'error' THEN 'outage' ELSE meter_name END AS meter_name,
  CASE WHEN quantity < 1 THEN 0.0 ELSE quantity END AS quantity, event_time,
  CASE WHEN meter_name = 'view' AND quantity > 80 THEN 'missing' WHEN meter_name = 'click' AND quantity > 70 THEN 'text' END AS fault
  FROM ev),
chk AS (SELECT *, CASE WHEN meter_name = 'outage' THEN 'meter "outage" was not found'
    WHEN fault = 'missing' THEN 'dimension "k" is required' WHEN fault = 'text' THEN 'dimension "k" must be number'
    WHEN subject[1] = '-' THEN 'subject must use letters, numbers, and _.:-'
    WHEN quantity <= 0 THEN 'quantity must be greater than zero' END AS message FROM raw),
good AS (SELECT * FROM chk WHERE message IS NULL)"""

# One batch: the first valid row per key wins.
ONE_BATCH = """ranked AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY index) AS rn,
  first_value(id) OVER (PARTITION BY workspace_id, idempotency_key ORDER BY index) AS original_id FROM good)"""

# Two batches: events of the odd hours were stored first, those of even hours follow.
TWO_BATCHES = """part1 AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY index) AS rn
  FROM good WHERE event_time < TIMESTAMP '2024-01-16 00:30:00'),
stored AS (SELECT * FROM part1 WHERE rn = 1),
part2 AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY index) AS rn
  FROM good WHERE event_time >= TIMESTAMP '2024-01-15 00:00:00')"""


def _validated(spark, folder) -> DataFrame:
    meters = event_meters(spark, folder).filter("name <> 'error'")
    validated = ingest.validate(faulty_raw(usage_from_events(spark, folder)), meters, NOW)
    return materialize(validated, "validated")


@query("ingest_failed", ctes(EV, RAW) + """SELECT workspace_id, index,
  CASE WHEN meter_name = 'outage' THEN 'not_found' ELSE 'invalid_input' END AS code, message FROM chk WHERE message IS NOT NULL""")
def ingest_failed(spark, folder):
    return ingest.failures(_validated(spark, folder))


@query(
    "ingest_accepted",
    ctes(EV, RAW, ONE_BATCH)
    + "SELECT id, workspace_id, idempotency_key, subject, meter_name, quantity, event_time FROM ranked WHERE rn = 1",
)
def ingest_accepted(spark, folder):
    accepted = ingest.dedupe_batch(ingest.valid_rows(_validated(spark, folder)))
    return accepted.select("id", "workspace_id", "idempotency_key", "subject", "meter_name", "quantity", "event_time")


def _batch_parts(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stored first batch and a second one that overlaps it: (ok, firsts, matched)."""
    ok = ingest.valid_rows(_validated(spark, folder))
    first = ingest.dedupe_batch(ok.filter(F.col("event_time") < ntz(SPLIT)))
    second = ok.filter(F.col("event_time") >= ntz("2024-01-15T00:00:00Z"))
    firsts = materialize(ingest.dedupe_batch(second), "firsts")
    matched = materialize(ingest.already_stored(firsts, first.select(*EVENT_COLUMNS)), "matched")
    return second, firsts, matched


@query(
    "ingest_second_batch",
    ctes(EV, RAW, TWO_BATCHES)
    + """SELECT id, workspace_id, subject, meter_name, quantity FROM part2 p WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.workspace_id = p.workspace_id AND s.idempotency_key = p.idempotency_key)""",
)
def ingest_second_batch(spark, folder):
    _, firsts, matched = _batch_parts(spark, folder)
    return ingest.accept(firsts, matched).select("id", "workspace_id", "subject", "meter_name", "quantity")


_DUPLICATES = """dup AS (SELECT p.index, p.workspace_id, coalesce(s.id, o.id) AS id, coalesce(s.quantity, o.quantity) AS quantity,
  coalesce(s.event_time, o.event_time) AS event_time FROM part2 p
  LEFT JOIN stored s ON s.workspace_id = p.workspace_id AND s.idempotency_key = p.idempotency_key
  LEFT JOIN (SELECT * FROM part2 WHERE rn = 1) o ON o.workspace_id = p.workspace_id AND o.idempotency_key = p.idempotency_key
  WHERE s.id IS NOT NULL OR p.id <> o.id)"""


@query(
    "ingest_duplicates",
    ctes(EV, RAW, TWO_BATCHES, _DUPLICATES) + "SELECT index, id, workspace_id, quantity, event_time FROM dup",
)
def ingest_duplicates(spark, folder):
    rows = ingest.duplicates(*_batch_parts(spark, folder))
    return rows.select("index", "id", "workspace_id", "quantity", "event_time")


@query(
    "ingest_all_events",
    ctes(EV, RAW, TWO_BATCHES, _DUPLICATES)
    + """SELECT id, count(*) AS copies FROM (SELECT id FROM dup UNION ALL SELECT id FROM part2 p WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.workspace_id = p.workspace_id AND s.idempotency_key = p.idempotency_key))
GROUP BY 1""",
)
def ingest_all_events(spark, folder):
    ok, firsts, matched = _batch_parts(spark, folder)
    both = ingest.all_events(ingest.accept(firsts, matched), ingest.duplicates(ok, firsts, matched))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "ingest_dotted_keys",
    ctes(EV, "keyed AS (SELECT *, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM ev WHERE quantity > 0)")
    + """SELECT id, CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END AS tier, CASE WHEN k % 3 = 1 THEN '2' END AS zone,
  k % 3 = 0 AS flat, CASE WHEN k % 3 = 0 THEN 'dimension "service.tier" conflicts with existing metadata' END AS message
FROM keyed""",
)
def ingest_dotted_keys(spark, folder):
    """A dotted dimension sent as a flat key: it becomes nested, next to what is there, or fails on a plain value."""
    dotted = F.transform("dimensions", lambda d: d.withField("name", F.lit("service.tier")))
    meters = materialize(event_meters(spark, folder).withColumn("dimensions", dotted), "dotted-meters")
    k = F.get_json_object("metadata", "$.k")
    others = F.when(k.cast("bigint") % 3 == 0, ', "service": 5').when(k.cast("bigint") % 3 == 1, ', "service": {"zone": 2}')
    sent = F.concat(F.lit('{"service.tier": '), k, F.coalesce(others, F.lit("")), F.lit("}"))
    raw = raw_from_usage(usage_from_events(spark, folder)).filter("quantity > 0").withColumn("metadata", sent)
    return ingest.validate(raw, meters, NOW).select(
        "id",
        F.get_json_object("metadata", "$.service.tier").alias("tier"),
        F.get_json_object("metadata", "$.service.zone").alias("zone"),
        F.array_contains(F.json_object_keys("metadata"), "service.tier").alias("flat"),
        "message",
    )


_STORED_DAYS = """stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key
  ORDER BY CAST(id AS BIGINT)) AS rn FROM ev WHERE event_time < TIMESTAMP '2024-01-21') WHERE rn = 1),
batch AS (SELECT * FROM ev WHERE event_time >= TIMESTAMP '2024-01-21' OR (event_time >= TIMESTAMP '2024-01-19'
  AND subject LIKE '%7'))"""


def _twenty_batches(spark, folder) -> tuple[EventStore, DataFrame]:
    """A store that remembers the keys of twenty daily batches, and a later batch that repeats some."""
    usage = usage_from_events(spark, folder)
    earlier = usage.filter(F.col("event_time") < ntz("2024-01-21T00:00:00Z"))
    first = F.min_by(F.struct("id", "event_time"), F.col("id").cast("bigint")).alias("first")
    kept = earlier.groupBy("workspace_id", "idempotency_key").agg(first).select("workspace_id", "idempotency_key", "first.*")
    store = EventStore(spark, scratch_path(spark, "many-batches"))
    day = F.date_format("event_time", "'day-'dd")
    store.write_keys(kept.withColumn("event_date", F.to_date("event_time")), day)
    entries = kept.select(day.alias("batch_id")).distinct()
    nobody = F.lit(None).cast("string").alias("workspace_id")
    store.put("ledger", entries.select(nobody, F.lit("bulk").alias("kind"), ntz(NOW).alias("committed_at"), "batch_id"))
    again = F.col("subject").endswith("7") & (F.col("event_time") >= ntz("2024-01-19T00:00:00Z"))
    later = usage.filter((F.col("event_time") >= ntz("2024-01-21T00:00:00Z")) | again)
    raw = raw_from_usage(later)
    ok = ingest.valid_rows(ingest.validate(raw, event_meters(spark, folder), NOW, "day-21"))
    return store, materialize(ingest.dedupe_batch(ok), "firsts")


@query(
    "ingest_many_batches",
    ctes(EV, _STORED_DAYS)
    + """SELECT s.workspace_id, s.idempotency_key, s.id, CAST(s.event_time AS DATE) AS event_date FROM stored s
WHERE EXISTS (SELECT 1 FROM batch b WHERE b.workspace_id = s.workspace_id AND b.idempotency_key = s.idempotency_key
  AND b.quantity > 0)""",
)
def ingest_many_batches(spark, folder):
    """The originals that a batch repeats, looked up in its own buckets of the key table."""
    store, firsts = _twenty_batches(spark, folder)
    return store.matched_keys(firsts, "day-21")


@query(
    "event_page_store",
    ctes(EV)
    + """SELECT id, subject, meter_name, quantity, event_time FROM ev WHERE workspace_id = 'ws_1'
  AND (event_time < TIMESTAMP '2024-01-20 12:00:00' OR (event_time = TIMESTAMP '2024-01-20 12:00:00' AND id < '500'))
ORDER BY event_time DESC, id DESC LIMIT 401""",
)
def event_page_store(spark, folder):
    """A page of a tenant's stored events after a cursor, from the newest day folders that fill it."""
    store = EventStore(spark, scratch_path(spark, "pages"))
    usage = usage_from_events(spark, folder).select(*EVENT_COLUMNS)
    dated = usage.select("*", F.lit("all").alias("ingest_batch"), F.to_date("event_time").alias("event_date"))
    store.write("events", dated, "all")
    store.write("ledger", usage.select("workspace_id", F.lit("bulk").alias("kind"), ntz(NOW).alias("committed_at")).distinct(), "all")
    found = store.event_page(400, (datetime(2024, 1, 20, 12), "500"), workspace="ws_1")
    return found.select("id", "subject", "meter_name", "quantity", "event_time")


class _StopsHalfWay(EventStore):
    """A store whose ingest ends between the events and the keys of a batch."""

    def write_keys(self, events, batch_id):
        raise InterruptedError


@query(
    "batch_replay",
    ctes(EV)
    + """SELECT * FROM (SELECT CASE rn WHEN 1 THEN 'accepted' ELSE 'duplicate' END AS outcome, id, subject, quantity
  FROM (SELECT first(id) OVER w AS id, subject, first(quantity) OVER w AS quantity, row_number() OVER w AS rn
    FROM ev WHERE workspace_id = 'ws_1' AND quantity > 0
    WINDOW w AS (PARTITION BY idempotency_key ORDER BY CAST(id AS BIGINT))))""",
)
def batch_replay(spark, folder):
    """A tenant's batch that stops after its events are written, runs again, and is then sent with other quantities.

    The second run starts over and the replay answers from the tables: the first payload's rows.
    """
    path, meters = scratch_path(spark, "replay"), event_meters(spark, folder)
    raw = raw_from_usage(usage_from_events(spark, folder))
    try:
        _StopsHalfWay(spark, path).ingest(raw, meters, "daily", NOW, workspace="ws_1")
    except InterruptedError:
        store = EventStore(spark, path)
    store.ingest(raw, meters, "daily", NOW, workspace="ws_1")
    other = raw.withColumn("quantity", F.col("quantity") + 1000)
    again = store.ingest(other, meters, "daily", NOW, workspace="ws_1")
    fields = ["id", "subject", "quantity"]
    accepted = again.accepted.select(F.lit("accepted").alias("outcome"), *fields)
    return accepted.unionByName(again.duplicates.select(F.lit("duplicate").alias("outcome"), *fields))


@query(
    "ingest_conflicting_ids",
    ctes(EV, RAW, TWO_BATCHES)
    + "SELECT DISTINCT p.id FROM part2 p JOIN stored s ON s.id = p.id",
)
def ingest_conflicting_ids(spark, folder):
    ok = ingest.valid_rows(_validated(spark, folder))
    first = ingest.dedupe_batch(ok.filter(F.col("event_time") < ntz(SPLIT)))
    return ingest.conflicting_ids(ok.filter(F.col("event_time") >= ntz("2024-01-15T00:00:00Z")), first)


@query(
    "ingest_run",
    ctes(EV, RAW, ONE_BATCH)
    + """SELECT 'run-1/' || workspace_id AS id, workspace_id, 'bulk' AS kind,
  (SELECT count(*) FROM ranked r WHERE r.workspace_id = c.workspace_id AND rn = 1) AS accepted,
  (SELECT count(*) FROM ranked r WHERE r.workspace_id = c.workspace_id AND rn > 1) AS duplicates,
  count(*) FILTER (message IS NOT NULL) AS failed, TIMESTAMP '2024-02-01' AS created_at FROM chk c GROUP BY workspace_id""",
)
def ingest_run(spark, folder):
    validated = _validated(spark, folder)
    accepted = ingest.dedupe_batch(ingest.valid_rows(validated))
    return ingest.ingestion_runs(validated, accepted, "bulk", "run-1", NOW)


@query(
    "affected_keys",
    ctes(EV, RAW) + "SELECT DISTINCT workspace_id, subject, meter_name FROM good",
)
def affected_keys(spark, folder):
    return ingest.affected_keys(ingest.valid_rows(_validated(spark, folder)))


@query(
    "rule_match",
    ctes(EV)
    + """SELECT DISTINCT workspace_id, workspace_id || '/' || meter_name || '/' || kind AS rule_id
FROM ev, (VALUES ('global'), ('subject'), ('k'), ('k42'), ('off')) t(kind)
WHERE (kind <> 'k42' OR json_extract_string(metadata, '$.k') = '42') AND NOT (kind = 'off' AND meter_name = 'view')""",
)
def rule_match(spark, folder):
    usage = usage_from_events(spark, folder)
    return ingest.matched_rules(usage, materialize(rules(event_meters(spark, folder)), "rules"))


@query(
    "recent_run_totals",
    """WITH r AS (SELECT o_orderkey, o_orderdate, count(l_orderkey) AS accepted, count(*) FILTER (l_returnflag = 'R') AS failed
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT * FROM r ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 20)
SELECT CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(failed) AS BIGINT) AS failed FROM n""",
)
def recent_run_totals(spark, folder):
    """Orders as ingestion runs whose line items were accepted, or failed if returned."""
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    )
    orders = table(spark, folder, "orders")
    runs = orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"], "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )
    return stats.recent_totals(runs, 20)


@query(
    "source_json_batch",
    ctes(EV)
    + """SELECT workspace_id, meter_name, count(*) AS rows, count(*) AS ids, count(*) AS indexes,
  count(*) FILTER (CAST(id AS BIGINT) % 7 = 0) AS bad_times,
  round(sum(quantity) FILTER (CAST(id AS BIGINT) % 7 <> 0), 6) AS quantity,
  max(event_time) FILTER (CAST(id AS BIGINT) % 7 <> 0) AS last_event_at
FROM ev GROUP BY 1, 2""",
)
def source_json_batch(spark, folder):
    """All events through JSON lines without ids or index; every seventh time is not a time."""
    usage = usage_from_events(spark, folder)
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = usage.select(
        "workspace_id",
        "subject",
        F.col("meter_name").alias("meter"),
        "quantity",
        F.when(F.col("id").cast("long") % 7 == 0, "not-a-time").otherwise(stamp).alias("timestamp"),
        F.parse_json("metadata").alias("metadata"),
    )
    path = scratch_path(spark, "json-batch")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    validated = materialize(ingest.validate(read_raw_json(spark, path), event_meters(spark, folder), NOW), "validated")
    ok = F.col("code").isNull()
    return validated.groupBy("workspace_id", "meter_name").agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.countDistinct("index").alias("indexes"),
        F.count_if(F.col("message") == "timestamp must be an RFC 3339 time").alias("bad_times"),
        F.round(F.sum(F.when(ok, F.col("quantity"))), 6).alias("quantity"),
        F.max(F.when(ok, F.col("event_time"))).alias("last_event_at"),
    )


# --- retention -------------------------------------------------------------------------------

_CUT = "cut AS (SELECT workspace_id, name AS meter_name, TIMESTAMP '2024-02-01' - to_days(event_retention_days) AS cutoff FROM met)"
_RECENT = "SELECT * FROM ev"


def _prune_inputs(spark, folder):
    usage = usage_from_events(spark, folder)
    return usage, retention.cutoffs(event_meters(spark, folder), NOW)


@query(
    "prune_dry_run",
    ctes(EV, MET, _CUT)
    + f"""SELECT c.workspace_id, c.meter_name, c.cutoff AS before, count(e.id) AS deleted FROM cut c
LEFT JOIN ({_RECENT}) e ON e.workspace_id = c.workspace_id AND e.meter_name = c.meter_name AND e.event_time < c.cutoff GROUP BY 1, 2, 3""",
)
def prune_dry_run(spark, folder):
    return retention.prunable_counts(*_prune_inputs(spark, folder))


@query(
    "prune_keep",
    ctes(EV, MET, _CUT)
    + f"""SELECT e.id, e.workspace_id, e.meter_name, e.event_time FROM ({_RECENT}) e JOIN cut c
  ON e.workspace_id = c.workspace_id AND e.meter_name = c.meter_name AND e.event_time >= c.cutoff""",
)
def prune_keep(spark, folder):
    rows = retention.kept_events(*_prune_inputs(spark, folder))
    return rows.select("id", "workspace_id", "meter_name", "event_time")


@query(
    "prune_store",
    ctes(EV, MET, _CUT)
    + """SELECT e.id, e.workspace_id, e.meter_name, e.event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY CAST(id AS BIGINT)) AS rn
  FROM ev WHERE quantity > 0) e JOIN cut c ON e.workspace_id = c.workspace_id AND e.meter_name = c.meter_name
WHERE rn = 1 AND (e.event_time >= c.cutoff OR CAST(replace(subject, 'user_', '') AS BIGINT) % 5 = 0)""",
)
def prune_store(spark, folder):
    """Most users' events, pruned; those of the others come afterwards and stay, old or not."""
    store, meters = EventStore(spark, scratch_path(spark, "prune")), event_meters(spark, folder)
    raw = raw_from_usage(usage_from_events(spark, folder))
    late = F.replace("subject", F.lit("user_"), F.lit("")).cast("bigint") % 5 == 0
    store.ingest(raw.filter(~late), meters, "first", NOW)
    store.prune(retention.cutoffs(meters, NOW), "prune", NOW)
    store.sweep()
    store.ingest(raw.filter(late), meters, "second", "2024-02-01T01:00:00Z")
    return store.events().select("id", "workspace_id", "meter_name", "event_time")


@query(
    "prune_run",
    ctes(EV, MET, _CUT)
    + f"""SELECT 'prune-1/' || workspace_id AS id, workspace_id, true AS dry_run, CAST(sum(deleted) AS BIGINT) AS deleted,
  count(*) AS meters, string_agg(meter_name || '=' || deleted, ',' ORDER BY meter_name) AS listing
FROM (SELECT c.workspace_id, c.meter_name, count(e.id) AS deleted FROM cut c LEFT JOIN ({_RECENT}) e
  ON e.workspace_id = c.workspace_id AND e.meter_name = c.meter_name AND e.event_time < c.cutoff GROUP BY 1, 2) GROUP BY workspace_id""",
)
def prune_run(spark, folder):
    run = retention.prune_run(retention.prunable_counts(*_prune_inputs(spark, folder)), True, "prune-1", NOW)
    entry = F.transform("meters", lambda m: F.concat(m["meter_name"], F.lit("="), m["deleted"].cast("string")))
    return run.select(
        "id",
        "workspace_id",
        "dry_run",
        "deleted",
        F.size("meters").cast("long").alias("meters"),
        F.array_join(entry, ",").alias("listing"),
    )


# --- catalog ------------------------------------------------------------------------------------


def _part_meters(spark, folder) -> DataFrame:
    """Parts as meter definitions; brand and size decide what is wrong with them."""
    size = F.col("p_size")
    dimension = F.struct(
        F.when(F.col("p_brand") == "Brand#3", "subject").otherwise(F.replace("p_name", F.lit(" "), F.lit("."))).alias("name"),
        F.lit("").alias("display_name"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("p_brand") == "Brand#5", "date").otherwise("string").alias("type"),
        (size > 25).alias("required"),
        F.lit(None).cast("boolean").alias("deprecated"),
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.lit("ws").alias("workspace_id"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("p_type") == "ECONOMY", "").otherwise("unit").alias("unit"),
        F.when(size == 7, "median").otherwise("").alias("aggregation"),
        F.array(dimension).alias("dimensions"),
        F.when(size > 45, -1).when(size < 3, 4000).otherwise(0).alias("event_retention_days"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "meter_validation",
    """SELECT 'ws' AS workspace_id, CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
  CASE WHEN p_type = 'ECONOMY' THEN 'meter unit is required' WHEN p_size = 7 THEN 'unsupported aggregation "median"'
       WHEN p_brand = 'Brand#3' THEN 'dimension name "subject" is reserved'
       WHEN p_brand = 'Brand#5' THEN 'unsupported dimension type "date"'
       WHEN p_size > 45 THEN 'event retention days must be greater than zero'
       ELSE 'event retention days cannot exceed 3650' END AS message
FROM part WHERE p_type = 'ECONOMY' OR p_size = 7 OR p_brand IN ('Brand#3', 'Brand#5') OR p_size > 45 OR p_size < 3""",
)
def meter_validation(spark, folder):
    return catalog.validate_meters(_part_meters(spark, folder))


@query(
    "meter_defaults",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size = 7 THEN 'median' ELSE 'sum' END AS aggregation,
  CAST(CASE WHEN p_size > 45 THEN -1 WHEN p_size < 3 THEN 4000 ELSE 90 END AS INTEGER) AS event_retention_days,
  CASE WHEN p_brand = 'Brand#3' THEN 'Subject' ELSE
    upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] END
  AS display_name FROM part""",
)
def meter_defaults(spark, folder):
    rows = catalog.normalize_meters(_part_meters(spark, folder))
    return rows.select(
        "id", "name", "aggregation", "event_retention_days", F.col("dimensions")[0]["display_name"].alias("display_name")
    )


@query(
    "meter_evolution",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS m, p_name, p_size, p_brand FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT 'ws' AS workspace_id, m AS meter_name, replace(p_name, ' ', '.') AS dimension, CASE
    WHEN p_size < 10 THEN 'cannot be removed after usage has been recorded'
    WHEN p_brand = 'Brand#4' THEN 'type cannot change after usage has been recorded'
    ELSE 'cannot become required after usage has been recorded' END AS message
FROM p WHERE p_size < 10 OR p_brand = 'Brand#4' OR p_size BETWEEN 15 AND 25
UNION ALL
SELECT 'ws', m, 'added', 'cannot be added after usage has been recorded' FROM p WHERE p_size > 35""",
)
def meter_evolution(spark, folder):
    """Parts as meters, returned line items as usage; the new version changes dimensions by size and brand."""
    size = F.col("p_size")

    def dimension(name, kind, required):
        return F.struct(
            name.alias("name"),
            F.lit("").alias("display_name"),
            F.lit("").alias("description"),
            kind.alias("type"),
            required.alias("required"),
            F.lit(False).alias("deprecated"),
        )

    name = F.replace("p_name", F.lit(" "), F.lit("."))
    part = table(spark, folder, "part")
    base = [F.lit("ws").alias("workspace_id"), F.col("p_partkey").cast("string").alias("name")]
    old = part.select(*base, F.array(dimension(name, F.lit("string"), size > 25)).alias("dimensions"))
    new_type = F.when(F.col("p_brand") == "Brand#4", "number").otherwise("string")
    kept = F.when(size >= 10, dimension(name, new_type, size >= 15))
    added = F.when(size > 35, dimension(F.lit("added"), F.lit("string"), F.lit(True)))
    new = part.select(*base, F.array_compact(F.array(kept, added)).alias("dimensions"))
    used = (
        table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(F.lit("ws").alias("workspace_id"), F.col("l_partkey").cast("string").alias("meter_name"))
    )
    return catalog.check_evolution(old, new, used)


@query(
    "catalog_upsert",
    """WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS id, l_shipdate AS updated_at,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS added, l_orderkey * 10 + l_linenumber AS payload FROM lineitem),
one AS (SELECT id, updated_at, added, max(payload) AS payload FROM a GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, added DESC) AS rn FROM one)
SELECT id, updated_at, payload FROM r WHERE rn = 1""",
)
def catalog_upsert(spark, folder):
    """Line items as versions of their part; the newest ship date stays, on equal dates a returned item."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"),
        F.col("l_shipdate").alias("updated_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payload"),
        "l_returnflag",
    )
    # One version per part and date on either side, as a catalog has.
    newest = F.max("payload").alias("payload")
    old = rows.filter("l_returnflag <> 'R'").groupBy("id", "updated_at").agg(newest)
    new = rows.filter("l_returnflag = 'R'").groupBy("id", "updated_at").agg(newest)
    return catalog.upsert(old, new, ["id"], "updated_at")


@query(
    "delete_guard",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
def delete_guard(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.delete_guard(customers, orders, ["c_custkey"])


@query(
    "export_status",
    """SELECT count(*) FILTER (o_orderstatus = 'P') AS active, count(*) FILTER (o_orderstatus = 'F') AS completed,
  count(*) FILTER (o_orderstatus = 'O') AS needs_action FROM orders""",
)
def export_status(spark, folder):
    """Orders as export jobs: P runs, F is completed, O failed or was canceled."""
    status = F.col("o_orderstatus")
    odd = F.col("o_orderpriority").startswith("1")
    jobs = table(spark, folder, "orders").select(
        F.when(status == "P", F.when(odd, "queued").otherwise("running"))
        .when(status == "F", "completed")
        .otherwise(F.when(odd, "canceled").otherwise("failed"))
        .alias("status")
    )
    return exports.export_status(jobs)



