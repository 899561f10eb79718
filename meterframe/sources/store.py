"""The event store: parquet tables under one root on shared storage.

Layout (every table is partitioned by the columns in brackets):

    events     [event_date, batch_id]   sorted by workspace, meter, subject and time
    keys       [key_bucket, batch_id]   idempotency keys: event id and date, in hash buckets
    duplicates [batch_id]               originals returned for duplicates
    panes      [event_date, batch_id]   mergeable partials for alert windows, if the store keeps them
    counters   [batch_id]               mergeable quota counter partials
    runs       [batch_id]               ingestion log
    ledger     [batch_id]               committed batches, written last
    staging    [batch_id]               validated rows of one batch
    firsts     [batch_id]               its first row per idempotency key
    matched    [batch_id]               stored keys that it repeats
    originals  [batch_id]               the events behind those keys
    quota_evaluations, alert_evaluations [batch_id]
                                        evaluation log; events and snapshots are views of it
    cutoffs    [batch_id]               retention: what a prune hides
    quota_current, alert_current [state_bucket, head]
                                        current states in hash buckets; a batch replaces the buckets it touches

A batch writes only its own `batch_id` partitions and overwrites them dynamically,
and readers see only batches in the ledger. A batch that failed half way can thus be
run again with the same id, and a committed one is answered from the tables.

Folders by date rather than by tenant and meter keep the number of files of a small
batch small; inside a file the sort order lets parquet skip the pages of other
tenants and meters.

A batch looks for its keys in the buckets that they fall into, and an evaluation reads and
replaces the buckets of the keys or rules it looks at, so neither depends on how many batches
came before. A `head` names one version of a bucket and the batch that wrote it; the newest
committed one counts, and the few before it stay for a batch that is run again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.metadata import meta_text, promoted_column
from meterframe.functions.timecalc import ntz
from meterframe.operators import alerts, entitlements, ingest, paging
from meterframe.operators.joins import latest_by, side_join
from meterframe.operators.scan import scan
from meterframe.schema import EVENT_COLUMNS, INGESTION_RUN, USAGE_EVENT

EVENTS_SCHEMA = f"{USAGE_EVENT}, ingest_batch string, event_date date, batch_id string"
KEYS_SCHEMA = "workspace_id string, idempotency_key string, id string, event_date date"
METER = ["workspace_id", "meter_name"]
# Buckets of a store's keys and current states; fixed for the life of a store.
KEY_BUCKETS = 32
STATE_BUCKETS = 8
# Committed versions of a state bucket that stay.
KEPT_HEADS = 2
POINT = "struct<event_time:timestamp_ntz,received_at:timestamp_ntz,id:string,quantity:double>"
COUNTERS_SCHEMA = (
    "workspace_id string, subject string, meter_name string, period string, "
    "period_start timestamp_ntz, period_end timestamp_ntz, event_count long, quantity_sum double, "
    f"quantity_min double, quantity_max double, first_event {POINT}, last_event {POINT}, batch_id string"
)
QUOTA_EVALUATION = (
    "workspace_id string, subject string, meter_name string, plan_id string, period string, "
    "period_start timestamp_ntz, period_end timestamp_ntz, current double, limit_value double, remaining double, "
    "warning_percent double, state string, event_count long, previous_state string, message string, "
    "event_type string, evaluated_at timestamp_ntz"
)
ALERT_EVALUATION = (
    "workspace_id string, rule_id string, group_key string, group_value string, status string, value double, "
    "usage_events long, message string, previous_status string, event_type string, evaluated_at timestamp_ntz"
)
QUOTA_STATE = (
    "workspace_id string, subject string, meter_name string, plan_id string, period string, state string, "
    "current double, limit_value double, remaining double, warning_percent double, message string, "
    "evaluated_at timestamp_ntz"
)
ALERT_STATE = (
    "workspace_id string, rule_id string, group_key string, group_value string, status string, value double, "
    "message string, evaluated_at timestamp_ntz, updated_at timestamp_ntz"
)
PANES_SCHEMA = (
    "workspace_id string, meter_name string, subject string, metadata string, event_time timestamp_ntz, "
    "received_at timestamp_ntz, event_count long, quantity_sum double, quantity_min double, quantity_max double, "
    f"first_event {POINT}, last_event {POINT}, event_date date, batch_id string"
)
LEDGER_SCHEMA = (
    "workspace_id string, kind string, committed_at timestamp_ntz, batch_id string"
)

PARTITIONS = {
    "events": ["event_date", "batch_id"],
    "keys": ["key_bucket", "batch_id"],
    "duplicates": ["batch_id"],
    "panes": ["event_date", "batch_id"],
    "counters": ["batch_id"],
    "runs": ["batch_id"],
    "ledger": ["batch_id"],
    "staging": ["batch_id"],
    "firsts": ["batch_id"],
    "matched": ["batch_id"],
    "originals": ["batch_id"],
    "quota_evaluations": ["batch_id"],
    "alert_evaluations": ["batch_id"],
    "cutoffs": ["batch_id"],
    "quota_current": ["state_bucket", "head"],
    "alert_current": ["state_bucket", "head"],
}
# What decides a row's bucket, and how a table's rows are laid out when written.
BUCKET_OF = {
    "keys": ("key_bucket", ["workspace_id", "idempotency_key"], KEY_BUCKETS),
    "quota_current": ("state_bucket", ["workspace_id", "subject"], STATE_BUCKETS),
    "alert_current": ("state_bucket", ["workspace_id", "rule_id"], STATE_BUCKETS),
}
SCHEMAS = {
    "events": EVENTS_SCHEMA,
    "keys": f"{KEYS_SCHEMA}, key_bucket int, batch_id string",
    "duplicates": f"index long, {USAGE_EVENT}, batch_id string",
    "panes": PANES_SCHEMA,
    "counters": COUNTERS_SCHEMA,
    "runs": f"{INGESTION_RUN}, batch_id string",
    "ledger": LEDGER_SCHEMA,
    "staging": f"index long, {USAGE_EVENT}, code string, message string, batch_id string",
    "firsts": f"index long, {USAGE_EVENT}, copies long, batch_id string",
    "matched": f"{KEYS_SCHEMA}, batch_id string",
    "originals": f"{USAGE_EVENT}, batch_id string",
    "quota_evaluations": f"{QUOTA_EVALUATION}, batch_id string",
    "alert_evaluations": f"{ALERT_EVALUATION}, batch_id string",
    "cutoffs": "workspace_id string, meter_name string, cutoff timestamp_ntz, pruned_at timestamp_ntz, batch_id string",
    "quota_current": f"{QUOTA_STATE}, state_bucket int, head string",
    "alert_current": f"{ALERT_STATE}, state_bucket int, head string",
}


def bucket(table: str) -> Column:
    """The hash bucket of a row of a bucketed table."""
    _, columns, buckets = BUCKET_OF[table]
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


@dataclass
class IngestResult:
    """What a batch did: DataFrames over the store's tables."""

    accepted: DataFrame
    duplicates: DataFrame
    failed: DataFrame
    replayed: bool


class EventStore:
    def __init__(
        self, spark: SparkSession, root: str, promote: tuple[str, ...] = (), panes: tuple[str, ...] | None = None
    ):
        """`promote` names metadata fields that are stored as text columns as well, for
        dimensions that many queries group by. `panes` names the metadata fields that alert
        rules test or group by (none: `()`); the store then keeps panes, from which such rules
        are evaluated without their events. Both are fixed for the life of a store."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.promote = promote
        self.pane_fields = panes
        self.promoted = [promoted_column(field) for field in promote]

    # --- tables -----------------------------------------------------------------

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm_path

    def exists(self, table: str) -> bool:
        fs, path = self._fs(self.path(table))
        return fs.exists(path)

    def raw_table(self, table: str) -> DataFrame:
        """A table with uncommitted batches included; empty when never written."""
        schema = SCHEMAS[table]
        if table == "events":
            schema = ", ".join([*[f"`{c}` string" for c in self.promoted], schema])
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def committed(self) -> DataFrame:
        """Ids of the batches that readers see."""
        return self.raw_table("ledger").select("batch_id").distinct()

    def table(self, table: str) -> DataFrame:
        """Rows of committed batches only.

        The ledger's batch ids meet the `batch_id` partition column, so other folders
        are pruned before they are read.
        """
        return self.raw_table(table).join(self.committed(), "batch_id", "left_semi")

    def own(self, table: str, batch_id: str) -> DataFrame:
        """What one batch wrote, committed or not."""
        return self.raw_table(table).filter(F.col("batch_id") == batch_id).drop("batch_id")

    def events(self) -> DataFrame:
        """Committed events that no prune hides."""
        promoted = [F.col(f"`{c}`") for c in self.promoted]
        rows = self.table("events").select(*EVENT_COLUMNS, "event_date", *promoted)
        cutoffs = self._cutoffs()
        return rows if cutoffs is None else self._marked(rows, cutoffs).filter(~F.col("pruned")).drop("pruned")

    def event_page(self, limit: int, after: tuple | None = None, **of) -> DataFrame:
        """The next `limit + 1` events after the cursor, newest first; `of` is what `scan` takes.

        Reads the newest day folders, four times as many at each attempt, and stops when
        the page is full. The list of days is the only thing that grows with the history.
        """
        days = [r[0] for r in self.raw_table("events").select("event_date").distinct().collect()]
        if after is not None:
            days = [day for day in days if day <= after[0].date()]
        days.sort(reverse=True)
        rows, span = scan(self.events(), **of), 1
        while days:
            part = rows.filter(F.col("event_date").between(F.lit(days[min(span, len(days)) - 1]), F.lit(days[0])))
            found = paging.event_page(part, limit, after)
            if span >= len(days) or found.count() > limit:
                return found
            span *= 4
        return paging.event_page(rows.limit(0), limit)

    def write(self, table: str, rows: DataFrame, batch_id: str) -> None:
        """Replace this batch's partitions of a table.

        Events are clustered by date, tenant and meter. `rebalance` lets Spark split what
        is large, also within one date, and merge what is small, so neither hot meters
        nor tiny files pile up. The other tables are written as their plan produced them.
        """
        self.put(table, rows.withColumn("batch_id", F.lit(batch_id)))

    def put(self, table: str, rows: DataFrame) -> None:
        """Replace the partitions that `rows`, which hold the partition columns, fall into."""
        if table in BUCKET_OF:  # one file for a bucket, more only if it is large
            rows = rows.hint("rebalance", BUCKET_OF[table][0])
        if table == "panes":
            rows = rows.hint("rebalance", "event_date")
        if table == "events":
            cluster = ["event_date", "workspace_id", "meter_name"]
            rows = rows.hint("rebalance", *cluster).sortWithinPartitions(*cluster, "subject", "event_time")
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS[table])
            .parquet(self.path(table))
        )

    # --- ingest -----------------------------------------------------------------

    @staticmethod
    def scoped(workspace: str, batch_id: str) -> str:
        """The store-wide id of a tenant's batch."""
        return f"{workspace}|{batch_id}"

    def is_committed(self, batch_id: str) -> bool:
        return not self.raw_table("ledger").filter(F.col("batch_id") == batch_id).isEmpty()

    def ingest(
        self,
        raw: DataFrame,
        meters: DataFrame,
        batch_id: str,
        now: str | datetime,
        kind: str = "bulk",
        assignments: DataFrame | None = None,
        reject_known_ids: bool = False,
        workspace: str | None = None,
    ) -> IngestResult:
        """Validate, deduplicate and append one batch; a committed batch is replayed.

        On replay the stored accepted and duplicate rows come back and the new payload
        only contributes its own failures. With `workspace` the batch is that tenant's:
        its rows alone are taken, and the same `batch_id` of another tenant is another
        batch. Without, `batch_id` must be unique in the store (as a stream's are).
        """
        if workspace is not None:
            raw = raw.filter(F.col("workspace_id") == workspace)
            batch_id = self.scoped(workspace, batch_id)
        validated = ingest.validate(raw, meters, now, batch_id)
        if self.is_committed(batch_id):
            return self.result(batch_id, ingest.failures(validated), replayed=True)

        # Written tables instead of caches: several steps read them, each costly input
        # (raw payload, deduplication, key table) is read once, and lost executors do
        # no harm.
        self.write("staging", validated, batch_id)
        staged = self.own("staging", batch_id)
        ok = ingest.valid_rows(staged)
        if reject_known_ids:
            clash = ingest.conflicting_ids(ok, self.events())
            if not clash.isEmpty():
                raise ValueError("event id conflicts with a stored event")

        self.write("firsts", ingest.dedupe_batch(ok), batch_id)
        firsts = self.own("firsts", batch_id)
        self.write("matched", self.matched_keys(firsts, batch_id), batch_id)
        matched = self.own("matched", batch_id)
        accepted = ingest.accept(firsts, matched).select(*EVENT_COLUMNS)
        dated = accepted.select(
            "*",
            F.lit(batch_id).alias("ingest_batch"),
            F.to_date("event_time").alias("event_date"),
            *[meta_text(field).alias(column) for field, column in zip(self.promote, self.promoted)],
        )
        self.write("events", dated, batch_id)

        mine = self.own("events", batch_id)
        if self.pane_fields is not None:
            panes = alerts.pane_partials(mine, self.pane_fields)
            self.write("panes", panes.withColumn("event_date", F.to_date("event_time")), batch_id)
        keyed = mine.filter(F.col("idempotency_key").isNotNull())
        self.write_keys(keyed, batch_id)
        # The originals are fetched by date folder and id, so only folders that hold
        # one are read.
        wanted = matched.select("event_date", "id")
        originals = self.events().join(wanted, ["event_date", "id"], "left_semi").select(*EVENT_COLUMNS)
        self.write("originals", originals, batch_id)
        self.write("duplicates", ingest.duplicates(ok, firsts, self.own("originals", batch_id)), batch_id)
        if assignments is not None:
            partials = entitlements.counter_partials(mine.select(*EVENT_COLUMNS), assignments)
            self.write("counters", partials, batch_id)
        runs = ingest.ingestion_runs(staged, mine, kind, batch_id, now)
        self.write("runs", runs, batch_id)
        ledger = runs.select(
            "workspace_id",
            F.lit(kind).alias("kind"),
            ntz(now).alias("committed_at"),
        )
        self.write("ledger", ledger.coalesce(1), batch_id)
        return self.result(batch_id, ingest.failures(staged), replayed=False)

    def write_keys(self, events: DataFrame, batch_id: str | Column) -> None:
        """Remember the keys of events under the batch, or the batches, they came with."""
        batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
        columns = ["workspace_id", "idempotency_key", "id", "event_date"]
        self.put("keys", events.select(*columns, bucket("keys").alias("key_bucket"), batch.alias("batch_id")))

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that rows fall into: at most the table's number of buckets."""
        return sorted(r[0] for r in rows.select(bucket(table)).distinct().collect())

    def buckets(self, table: str, numbers: list[int]) -> DataFrame:
        """Rows of some buckets; other buckets are neither listed nor read."""
        column = BUCKET_OF[table][0]
        folders = [f"{self.path(table)}/{column}={n}" for n in numbers]
        present = [f for f in folders if self._fs(f)[0].exists(self._fs(f)[1])]
        if not present:
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.option("basePath", self.path(table))
        return reader.schema(SCHEMAS[table]).parquet(*present)

    def matched_keys(self, firsts: DataFrame, batch_id: str) -> DataFrame:
        """Keys of other committed batches that occur in a batch, looked up in its buckets only."""
        keyed = firsts.filter(F.col("idempotency_key").isNotNull())
        stored = self.buckets("keys", self.touched("keys", keyed)).filter(F.col("batch_id") != batch_id)
        stored = stored.join(self.committed(), "batch_id", "left_semi").drop("batch_id", "key_bucket")
        return ingest.already_stored(firsts, stored)

    def result(self, batch_id: str, failed: DataFrame, replayed: bool) -> IngestResult:
        """A batch's rows."""
        return IngestResult(
            self.own("events", batch_id).select(*EVENT_COLUMNS),
            self.own("duplicates", batch_id).select("index", *EVENT_COLUMNS),
            failed,
            replayed,
        )

    def counters(self) -> DataFrame:
        """Quota counters: the merge of all committed partials."""
        return entitlements.merge_counters(self.table("counters"))

    def runs(self) -> DataFrame:
        return self.raw_table("runs").join(self.raw_table("ledger").select("batch_id"), "batch_id", "left_semi").drop(
            "batch_id"
        )

    def _delete(self, folders: list[str]) -> None:
        jvm = self.spark._jvm
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- evaluation state ---------------------------------------------------------

    def _log(self, table: str) -> DataFrame:
        """Evaluation rows of committed batches."""
        return self.table(table).drop("batch_id")

    def _current(self, table: str, without_batch: str | None = None, numbers: list[int] | None = None) -> DataFrame | None:
        """Rows of the newest committed version of each bucket (of some, if given), with its `head`.

        Which version that is follows from the partition columns: at most a few rows per
        bucket, whatever the number of batches. None when nothing was ever written.
        """
        if not self.exists(table):
            return None
        rows = self.raw_table(table)
        if numbers is not None:
            rows = rows.filter(F.col("state_bucket").isin(numbers) if numbers else F.lit(False))
        newest = self._heads(rows, without_batch).groupBy("state_bucket").agg(F.max("head").alias("head")).collect()
        chosen = [(F.col("state_bucket") == r["state_bucket"]) & (F.col("head") == r["head"]) for r in newest]
        return rows.filter(reduce(lambda a, b: a | b, chosen, F.lit(False)))

    def _heads(self, rows: DataFrame, without_batch: str | None = None) -> DataFrame:
        """Versions of state buckets that committed batches wrote."""
        heads = rows.select("state_bucket", "head").distinct()
        heads = heads.withColumn("batch_id", F.regexp_extract("head", r"^\d+~(?s)(.*)$", 1))
        if without_batch is not None:
            heads = heads.filter(F.col("batch_id") != without_batch)
        return heads.join(self.committed(), "batch_id", "left_semi")

    def _replace(self, table: str, states: DataFrame, key: list[str], batch_id: str, numbers: list[int]) -> None:
        """A new version of the touched buckets: their states with the new ones in place.

        Versions beyond the kept ones go once this one is written. A version that a failed
        batch left behind is not counted and goes with them.
        """
        before = self._current(table, batch_id, numbers)
        fresh = states.withColumn("__new", F.lit(1))
        if before is not None:
            old = before.select(*states.columns).withColumn("__new", F.lit(0))
            fresh = latest_by(fresh.unionByName(old), key, ["evaluated_at", "__new"])
        version = 0
        if self.exists(table):
            newest = self.raw_table(table).agg(F.max("head")).first()[0]
            version = int(newest.split("~", 1)[0]) + 1 if newest else 0
        rows = fresh.drop("__new").withColumn("state_bucket", bucket(table))
        self.put(table, rows.withColumn("head", F.lit(f"{version:012d}~{batch_id}")))
        if version:
            self._drop_old_heads(table, numbers, version)

    def _drop_old_heads(self, table: str, numbers: list[int], version: int) -> None:
        rows = self.raw_table(table).filter(F.col("state_bucket").isin(numbers))
        kept = self._heads(rows).groupBy("state_bucket").agg(F.sort_array(F.collect_set("head"), asc=False).alias("heads"))
        oldest = kept.select("state_bucket", F.try_element_at("heads", F.lit(KEPT_HEADS + 1)).alias("oldest"))
        folders = rows.select("state_bucket", "head", _folder().alias("folder")).distinct()
        doomed = folders.join(F.broadcast(oldest), "state_bucket").filter(F.col("head") <= F.col("oldest"))
        self._delete([r["folder"] for r in doomed.select("folder").distinct().collect()])

    def quota_states(self, without_batch: str | None = None, numbers: list[int] | None = None) -> DataFrame:
        """Current quota state per key, of all buckets or of some."""
        rows = self._current("quota_current", without_batch, numbers)
        if rows is None:
            return self.spark.createDataFrame([], QUOTA_STATE)
        return rows.drop("state_bucket", "head")

    def quota_events(self) -> DataFrame:
        return entitlements.events_of(self._log("quota_evaluations"))

    def quota_snapshots(self) -> DataFrame:
        """Latest snapshot per key and period start."""
        rows = self._log("quota_evaluations")
        snapshots = entitlements.snapshots(rows, F.col("evaluated_at").alias("updated_at"))
        return latest_by(snapshots, [*entitlements.STATE_KEY, "period_start"], ["updated_at"])

    def alert_states(self, without_batch: str | None = None, numbers: list[int] | None = None) -> DataFrame:
        """Current state per rule and group, of all buckets or of some."""
        rows = self._current("alert_current", without_batch, numbers)
        if rows is None:
            return self.spark.createDataFrame([], ALERT_STATE)
        return rows.drop("state_bucket", "head")

    def alert_events(self) -> DataFrame:
        return alerts.events_of(self._log("alert_evaluations"))

    def evaluate_quotas(
        self, batch_id: str, assignments: DataFrame, limits: DataFrame, meters: DataFrame, now: str | datetime
    ) -> None:
        """Evaluate the keys a batch touched; repeating it replaces its own log rows."""
        keys = ingest.affected_keys(self.own("events", batch_id))
        # Only the touched subjects' assignments and counters take part.
        subjects = keys.select("workspace_id", "subject").distinct()
        numbers = self.touched("quota_current", subjects)
        touched = assignments.join(subjects, ["workspace_id", "subject"], "left_semi")
        counters = self.table("counters").join(subjects, ["workspace_id", "subject"], "left_semi")
        evaluated = entitlements.evaluate(
            keys,
            touched,
            limits,
            meters,
            entitlements.merge_counters(counters),
            self.quota_states(batch_id, numbers),
            now,
        )
        columns = [c.split()[0] for c in QUOTA_EVALUATION.split(", ")]
        self.write("quota_evaluations", evaluated.select(*columns), batch_id)
        written = self.own("quota_evaluations", batch_id)
        self._replace("quota_current", entitlements.states(written), entitlements.STATE_KEY, batch_id, numbers)

    def late_windows(
        self, batch_id: str, closed_by: str | datetime, assignments: DataFrame, limits: DataFrame, meters: DataFrame
    ) -> DataFrame:
        """New snapshots of the quota windows that were over by `closed_by` and that a committed batch still changed.

        The batch's own counter partials tell which windows those are; no other window is
        merged and no event is read. `closed_by` is the time of the evaluation before.
        """
        over = self.own("counters", batch_id).filter(F.col("period_end") <= ntz(closed_by))
        changed = over.select(*entitlements.COUNTER_KEY).distinct()
        return entitlements.closed_windows(changed, self.table("counters"), assignments, limits, meters)

    def evaluate_alerts(self, batch_id: str, rules: DataFrame, meters: DataFrame, now: str | datetime) -> None:
        """Evaluate the rules that are due or that a batch touched; repeating it replaces its own log rows.

        Due rules take part without events, so that a rule whose usage stops becomes `no_data`;
        between batches call it with a fresh `batch_id`, which is then committed as a tick.
        """
        touched = ingest.matched_rules(self.own("events", batch_id).select(*EVENT_COLUMNS), rules)
        due = alerts.due_rules(rules, now).select("workspace_id", "rule_id")
        active = rules.join(touched.unionByName(due), ["workspace_id", "rule_id"], "left_semi")
        numbers = self.touched("alert_current", active)
        previous = alerts.of_known_rules(self.alert_states(batch_id, numbers), active)
        values = None if self.pane_fields is None else self.alert_values(active, meters, now)
        self.write("alert_evaluations", alerts.evaluate(active, self.events(), meters, previous, now, values), batch_id)
        written = self.own("alert_evaluations", batch_id)
        self._replace("alert_current", alerts.states(written), alerts.GROUP, batch_id, numbers)
        if not self.is_committed(batch_id):  # a tick of its own, without ingested events
            entry = self.spark.createDataFrame([(None, "evaluation", None)], LEDGER_SCHEMA.rsplit(",", 1)[0])
            self.write("ledger", entry.withColumn("committed_at", ntz(now)).coalesce(1), batch_id)

    def panes(self) -> DataFrame:
        """Committed panes that no prune hides; right for meters whose cutoffs lie on pane edges."""
        rows, cutoffs = self.table("panes").drop("batch_id"), self._cutoffs()
        return rows if cutoffs is None else self._marked(rows, cutoffs).filter(~F.col("pruned")).drop("pruned")

    def alert_values(self, rules: DataFrame, meters: DataFrame, now: str | datetime) -> DataFrame:
        """Value and event count per (enabled rule, group) at `now`, from panes where they are exact.

        Events are read only for the rules that panes cannot answer: those with other metadata
        fields, with a window that is no multiple of a pane, or of a meter with a cutoff inside
        a pane; and for all rules if `now` lies inside a pane.
        """
        rules = alerts.normalize_rules(rules).filter("enabled")
        if self.pane_fields is None or not alerts.on_pane_edge(now):
            return alerts.rule_values(rules, self.events(), meters, now)
        answered = alerts.of_panes(self.pane_fields)
        paned, rest = rules.filter(answered), rules.filter(~answered)
        cutoffs = self._cutoffs()
        if cutoffs is not None:
            inside = cutoffs.filter(F.exists("cuts", lambda c: c["cutoff"] != F.date_trunc("minute", c["cutoff"]).cast("timestamp_ntz")))
            rest = rest.unionByName(paned.join(inside, METER, "left_semi").select(*rest.columns))
            paned = paned.join(inside, METER, "left_anti").select(*rest.columns)
        values = alerts.pane_values(paned, self.panes(), meters, now)
        if rest.isEmpty():
            return values
        return values.unionByName(alerts.rule_values(rest, self.events(), meters, now))

    # --- retention --------------------------------------------------------------

    def prune(self, cutoffs: DataFrame, batch_id: str, now: str | datetime) -> None:
        """Hide the events that came by `now` and are older than their meter's cutoff.

        Only cutoffs are written, and the ledger entry makes them count at once: a reader sees
        all events or the pruned ones, never a part. Events that arrive later are new, however
        old their time. Keys and counters stay, so deduplication and quotas survive pruning.
        """
        self.write("cutoffs", cutoffs.select(*METER, "cutoff", ntz(now).alias("pruned_at")), batch_id)
        entry = self.spark.createDataFrame([(None, "prune", None)], LEDGER_SCHEMA.rsplit(",", 1)[0])
        self.write("ledger", entry.withColumn("committed_at", ntz(now)).coalesce(1), batch_id)

    def _cutoffs(self) -> DataFrame | None:
        """Per meter the cutoffs that count, one row; those that a wider and later one covers drop out."""
        if not self.exists("cutoffs"):
            return None
        cuts = F.collect_set(F.struct("cutoff", "pruned_at"))
        found = self.table("cutoffs").groupBy(*METER).agg(cuts.alias("all_cuts"))

        def covered(cut: Column) -> Column:
            def covers(other: Column) -> Column:
                wider = (other["cutoff"] >= cut["cutoff"]) & (other["pruned_at"] >= cut["pruned_at"])
                return wider & (other != cut)

            return F.exists("all_cuts", covers)

        return found.select(*METER, F.filter("all_cuts", lambda cut: ~covered(cut)).alias("cuts"))

    def _marked(self, events: DataFrame, cutoffs: DataFrame) -> DataFrame:
        """Adds `pruned`: whether a cutoff hides the event."""
        hidden = F.exists("cuts", lambda c: (F.col("event_time") < c["cutoff"]) & (F.col("received_at") <= c["pruned_at"]))
        joined = side_join(events, cutoffs, METER, "left", spread=F.xxhash64("subject", "event_time"))
        return joined.withColumn("pruned", F.coalesce(hidden, F.lit(False))).drop("cuts")

    def sweep(self) -> list[str]:
        """Delete the event folders of which nothing is visible any more; returns them.

        No result changes. Run it when readers that began before the last `prune` are done.
        Folders that no cutoff reaches are not read, and of the others no metadata is.
        """
        cutoffs = self._cutoffs()
        if cutoffs is None:
            return []
        highest = cutoffs.agg(F.to_date(F.max(F.array_max("cuts.cutoff")))).first()[0]
        if highest is None:
            return []
        reached = self.raw_table("events").filter(F.col("event_date") <= F.lit(highest))
        rows = reached.select("event_date", "batch_id", *METER, "subject", "event_time", "received_at", _folder().alias("folder"))
        rows = rows.join(self.committed(), "batch_id", "left_semi")
        dead = self._marked(rows, cutoffs).groupBy("event_date", "folder").agg(F.every("pruned").alias("dead"))
        doomed = [r["folder"] for r in dead.filter("dead").select("folder").toLocalIterator()]
        self._delete(doomed)
        return doomed


def _folder() -> Column:
    """The folder a row's file lies in."""
    return F.regexp_replace("_metadata.file_path", "/[^/]+$", "")
