"""Batch ingestion: validate, normalise, split, deduplicate, account.

Raw rows follow `schema.RAW_EVENT`. Validation comes before deduplication, so a
rejected row never uses up an idempotency key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.metadata import variant_type
from meterframe.functions.predicates import metadata_map_matches
from meterframe.functions.timecalc import ntz
from meterframe.operators.joins import fits, side_join
from meterframe.schema import DIMENSION, EVENT_COLUMNS, SUBJECT_MAX_BYTES, SUBJECT_PATTERN

INVALID = "invalid_input"
NOT_FOUND = "not_found"


def subject_error(subject: Column) -> Column:
    """Message for a subject outside the grammar, else NULL."""
    return (
        F.when(subject.isNull() | (subject == ""), "subject is required")
        .when(F.octet_length(subject) > SUBJECT_MAX_BYTES, f"subject cannot exceed {SUBJECT_MAX_BYTES} characters")
        .when(~subject.rlike(SUBJECT_PATTERN), "subject must use letters, numbers, and _.:-")
    )


def _path(name: Column, nested: bool) -> Column:
    inner = F.replace(name, F.lit("."), F.lit("']['")) if nested else name
    return F.concat(F.lit("$['"), inner, F.lit("']"))


def dimension_error(dimensions: Column, parsed: Column) -> Column:
    """Message for the first declared dimension the parsed metadata breaks, else NULL.

    The literal dotted key wins over the nested path. Deprecated dimensions are not
    required; a present value must have the declared type.
    """

    def check(dimension: Column) -> Column:
        name = dimension["name"]
        value = F.coalesce(
            F.try_variant_get(parsed, _path(name, False), "variant"),
            F.try_variant_get(parsed, _path(name, True), "variant"),
        )
        required = dimension["required"] & ~F.coalesce(dimension["deprecated"], F.lit(False))
        missing = F.concat(F.lit('dimension "'), name, F.lit('" is required'))
        mistyped = F.concat(F.lit('dimension "'), name, F.lit('" must be '), dimension["type"])
        return F.when(value.isNull(), F.when(required, missing)).when(
            variant_type(value) != dimension["type"], mistyped
        )

    return F.try_element_at(F.array_compact(F.transform(dimensions, check)), F.lit(1))


def resolve_meters(raw: DataFrame, meters: DataFrame) -> DataFrame:
    """Left lookup of the meter by exact name; `meter_found` is NULL when unknown."""
    side = meters.select(
        "workspace_id",
        F.col("name").alias("meter"),
        F.col("dimensions").alias("meter_dimensions"),
        F.lit(True).alias("meter_found"),
    )
    return side_join(raw, side, ["workspace_id", "meter"], "left", spread=F.xxhash64("index", "id"))


def clean(raw: DataFrame, now, batch_id: str = "") -> DataFrame:
    """Trim text, default the event time, index and metadata, and give every row an id.

    A row's position in the batch stands in for a missing index. Generated ids hash
    (workspace, batch, position), so they differ between rows whatever the payload says,
    and a retried batch, which reads the same rows, produces the same ids again.
    `bad_timestamp` (optional) marks rows whose time could not be read.
    """
    position = F.monotonically_increasing_id()
    bad_time = F.col("bad_timestamp") if "bad_timestamp" in raw.columns else F.lit(False)
    raw = raw.withColumn("bad_timestamp", F.coalesce(bad_time, F.lit(False))).withColumn("position", position)
    space = F.coalesce("workspace_id", F.lit(""))
    generated = F.sha2(F.concat_ws("|", space, F.lit(batch_id), F.col("position").cast("string")), 256)
    return raw.select(
        F.coalesce(F.col("index"), F.col("position")).cast(raw.schema["index"].dataType).alias("index"),
        F.coalesce(F.nullif(F.trim("id"), F.lit("")), generated).alias("id"),
        "workspace_id",
        F.nullif(F.trim("idempotency_key"), F.lit("")).alias("idempotency_key"),
        F.trim("subject").alias("subject"),
        # Not NULL, so that rows without a meter can be spread like any other hot key.
        F.coalesce(F.trim("meter"), F.lit("")).alias("meter"),
        "quantity",
        F.coalesce(F.col("timestamp"), ntz(now)).alias("timestamp"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        "bad_timestamp",
    )


def validate(raw: DataFrame, meters: DataFrame, now, batch_id: str = "", received_at: Column | None = None) -> DataFrame:
    """Event columns plus `index`, `code` and `message`; the latter two are NULL when valid.

    Write the result before splitting it: a filter on `message` would be pushed into the
    checks and run them once per use.
    """
    rows = resolve_meters(clean(raw, now, batch_id), meters)
    rows = normalize_metadata(rows, meters)
    # Parsed once per row; a column of its own keeps the checks from parsing again.
    rows = rows.withColumn("parsed", F.try_parse_json("metadata"))
    bad_json = F.col("parsed").isNull() | ~F.ltrim("metadata").startswith("{")
    message = (
        F.when(F.col("bad_timestamp"), "timestamp must be an RFC 3339 time")
        .when(F.col("meter") == "", "meter is required")
        .when(F.col("meter_found").isNull(), F.concat(F.lit('meter "'), F.col("meter"), F.lit('" was not found')))
        .when(bad_json, "metadata must be a JSON object")
        .when(F.col("metadata_error").isNotNull(), F.col("metadata_error"))
        .otherwise(
            F.coalesce(
                dimension_error(F.col("meter_dimensions"), F.col("parsed")),
                subject_error(F.col("subject")),
                F.when(
                    F.col("quantity").isNull() | F.isnan("quantity") | (F.col("quantity") <= 0),
                    "quantity must be greater than zero",
                ),
            )
        )
    )
    unknown_meter = F.col("meter_found").isNull() & (F.col("meter") != "") & ~F.col("bad_timestamp")
    return rows.withColumn("message", message).select(
        "index",
        "id",
        "workspace_id",
        "idempotency_key",
        "subject",
        F.col("meter").alias("meter_name"),
        "quantity",
        F.col("timestamp").alias("event_time"),
        (received_at if received_at is not None else ntz(now)).alias("received_at"),
        "metadata",
        F.when(F.col("message").isNull(), F.lit(None).cast("string"))
        .when(unknown_meter, NOT_FOUND)
        .otherwise(INVALID)
        .alias("code"),
        "message",
    )


# --- dotted keys -----------------------------------------------------------------


ENTRIES = "map<string,variant>"


def _with(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _put(text: Column, parts: Column, value: Column, at: int, depth: int) -> Column:
    """The JSON object `text` with `value` at the path `parts[at:]`; NULL if something else is in its way."""

    def into(entries: Column) -> Column:
        part = F.get(parts, F.lit(at))
        inner = value
        if at + 1 < depth:
            child = F.coalesce(F.to_json(F.try_element_at(entries, part)), F.lit("{}"))
            deeper = _with(child, lambda c: F.when(c.startswith("{"), _put(c, parts, value, at + 1, depth)))
            inner = F.when(F.size(parts) == at + 1, value).otherwise(deeper)
        others = F.map_filter(entries, lambda key, _: key != part)
        return _with(inner, lambda v: F.when(v.isNotNull(), F.to_json(F.map_concat(others, F.create_map(part, F.parse_json(v))))))

    return _with(F.from_json(text, ENTRIES), into)


def nest_dotted_keys(metadata: Column, names: Column, depth: int) -> Column:
    """Moves flat dotted keys to their nested place, one after the other; struct of `metadata` and `error`.

    `depth` is the largest number of parts of a name. If a part of a path is there and is
    no object, the metadata stays as it was and `error` tells the first such name. The objects
    on a path are written anew, with numbers as VARIANT prints them.
    """

    def step(state: Column, name: Column) -> Column:
        def move(entries: Column) -> Column:
            rest = F.to_json(F.map_filter(entries, lambda key, _: key != name))
            value = F.to_json(F.try_element_at(entries, name))
            moved = _put(rest, F.split(name, r"\."), value, 0, depth)
            return F.when(value.isNull(), state["metadata"]).otherwise(moved)

        conflict = F.concat(F.lit('dimension "'), name, F.lit('" conflicts with existing metadata'))
        done = _with(
            _with(F.from_json(state["metadata"], ENTRIES), move),
            lambda text: F.struct(F.coalesce(text, metadata).alias("metadata"), F.when(text.isNull(), conflict).alias("error")),
        )
        return F.when(state["error"].isNotNull(), state).otherwise(done)

    start = F.struct(metadata.alias("metadata"), F.lit(None).cast("string").alias("error"))
    return F.aggregate(names, start, step)


def normalize_metadata(rows: DataFrame, meters: DataFrame) -> DataFrame:
    """Rewrite flat dotted keys of declared dimensions as nested objects.

    Only if some meter declares a dotted dimension, and only in the rows that carry such a key.
    """
    parts = F.transform("dimensions", lambda d: F.size(F.split(d["name"], r"\.")))
    depth = meters.agg(F.max(F.array_max(parts))).first()[0] or 0
    if depth < 2:
        return rows.select("*", F.lit(None).cast("string").alias("metadata_error"))
    flat_keys = F.json_object_keys("metadata")
    dotted = F.filter(
        F.transform(F.coalesce("meter_dimensions", F.array().cast(f"array<{DIMENSION}>")), lambda d: d["name"]),
        lambda name: name.contains(".") & F.array_contains(flat_keys, name),
    )
    rows = rows.withColumn("flat_dotted", F.when(flat_keys.isNotNull(), dotted))
    nested = F.when(F.size("flat_dotted") > 0, nest_dotted_keys(F.col("metadata"), F.col("flat_dotted"), depth))
    rows = rows.withColumn("nested", nested)
    return rows.select(
        *[c for c in rows.columns if c not in ("metadata", "flat_dotted", "nested")],
        F.coalesce("nested.metadata", "metadata").alias("metadata"),
        F.col("nested.error").alias("metadata_error"),
    )


# --- split and deduplicate -------------------------------------------------------


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("message").isNull()).drop("code", "message")


def failures(validated: DataFrame) -> DataFrame:
    """Rejected rows as `(workspace_id, index, code, message)`."""
    return validated.filter(F.col("code").isNotNull()).select("workspace_id", "index", "code", "message")


def dedupe_batch(ok: DataFrame) -> DataFrame:
    """The first row per (workspace, key) in input order; rows without a key all stay.

    `min_by` on the whole row combines on the map side, so a key repeated in a third
    of the batch sends one row per task. `copies` counts the rows of the key.
    """
    rest = [c for c in ok.columns if c not in ("workspace_id", "idempotency_key")]
    first = F.min_by(F.struct(*rest), F.struct("index", "id")).alias("first")
    keyed = (
        ok.filter(F.col("idempotency_key").isNotNull())
        .groupBy("workspace_id", "idempotency_key")
        .agg(first, F.count(F.lit(1)).alias("copies"))
        .select("workspace_id", "idempotency_key", "first.*", "copies")
    )
    unkeyed = ok.filter(F.col("idempotency_key").isNull()).withColumn("copies", F.lit(1).cast("long"))
    return keyed.unionByName(unkeyed).select(*ok.columns, "copies")


def already_stored(firsts: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows whose (workspace, key) occurs in the batch.

    The stored side is filtered by the batch's keys: Spark broadcasts them when they
    are few and builds a runtime bloom filter or shuffles both sides when not.
    """
    keys = ["workspace_id", "idempotency_key"]
    batch_keys = firsts.filter(F.col("idempotency_key").isNotNull()).select(*keys)
    return stored.join(batch_keys, keys, "left_semi")


def accept(firsts: DataFrame, matched: DataFrame) -> DataFrame:
    """First rows whose key is not stored yet.

    Rows without a key stay out of the join: their NULL keys would all meet in one task.
    """
    keys = ["workspace_id", "idempotency_key"]
    has_key = F.col("idempotency_key").isNotNull()
    fresh = firsts.filter(has_key).join(matched.select(*keys), keys, "left_anti")
    return fresh.select(*firsts.columns).unionByName(firsts.filter(~has_key))


def duplicates(ok: DataFrame, firsts: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per duplicate: its index and the ORIGINAL event it stands for.

    The original is the stored event if the key was stored before, else the first
    row of the batch. The join salts hot keys, so a key repeated very often does not
    land in one task. `firsts` and `matched` should be written tables: they are read
    several times.
    """
    keys = ["workspace_id", "idempotency_key"]
    body = [c for c in EVENT_COLUMNS if c not in keys]
    nothing = F.lit(None).cast(firsts.schema["index"].dataType).alias("first_index")
    stored = matched.select(*keys, F.struct(*body).alias("original"), nothing)
    batch = firsts.filter(F.col("idempotency_key").isNotNull() & (F.col("copies") > 1))
    fresh = batch.join(stored.select(*keys), keys, "left_anti").select(
        *keys, F.struct(*body).alias("original"), F.col("index").alias("first_index")
    )
    candidates = ok.filter(F.col("idempotency_key").isNotNull()).select("index", "id", *keys)
    small = fits(matched) and fits(batch)
    joined = side_join(candidates, stored.unionByName(fresh), keys, small=small)
    # Ids may repeat within a batch, so the first row is told by its index as well.
    is_first = (F.col("index") == F.col("first_index")) & (F.col("id") == F.col("original.id"))
    repeated = joined.filter(F.col("first_index").isNull() | ~is_first)
    return repeated.select("index", *keys, "original.*").select("index", *EVENT_COLUMNS)


def all_events(accepted: DataFrame, duplicate_rows: DataFrame) -> DataFrame:
    """Accepted events followed by the originals of duplicates."""
    return accepted.select(*EVENT_COLUMNS).unionByName(duplicate_rows.select(*EVENT_COLUMNS))


def conflicting_ids(ok: DataFrame, stored: DataFrame) -> DataFrame:
    """Event ids that repeat in the batch or are already stored."""
    repeated = ok.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    known = ok.select("id").join(stored.select("id"), "id", "left_semi")
    return repeated.unionByName(known).distinct()


def ingestion_runs(validated: DataFrame, accepted: DataFrame, kind: str, run_id: str, now) -> DataFrame:
    """One log row per workspace: accepted, duplicate and failed counts."""
    zero = F.lit(0).cast("long")
    counted = validated.groupBy("workspace_id").agg(
        F.count_if(F.col("code").isNull()).alias("ok"), F.count_if(F.col("code").isNotNull()).alias("failed")
    )
    taken = accepted.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("taken"))
    both = counted.select("workspace_id", "ok", "failed", zero.alias("taken")).unionByName(
        taken.select("workspace_id", zero.alias("ok"), zero.alias("failed"), "taken")
    )
    totals = both.groupBy("workspace_id").agg(
        F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.sum("taken").alias("accepted")
    )
    return totals.select(
        F.concat_ws("/", F.lit(run_id), "workspace_id").alias("id"),
        "workspace_id",
        F.lit(kind).alias("kind"),
        "accepted",
        (F.col("ok") - F.col("accepted")).alias("duplicates"),
        "failed",
        ntz(now).alias("created_at"),
    )


def affected_keys(accepted: DataFrame) -> DataFrame:
    """Distinct (workspace, subject, meter) that need a quota evaluation."""
    return accepted.select("workspace_id", "subject", "meter_name").distinct()


def matched_rules(accepted: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct enabled rules that some accepted event touches.

    Every event reduces to the rules it matches before anything is shuffled.
    """
    side = rules.filter("enabled").select(
        "workspace_id",
        "meter_name",
        "rule_id",
        F.col("subject").alias("rule_subject"),
        F.col("metadata").alias("rule_metadata"),
    )
    any_subject = F.col("rule_subject").isNull() | (F.col("rule_subject") == "")
    residual = (any_subject | (F.col("rule_subject") == F.col("subject"))) & metadata_map_matches(
        F.col("rule_metadata"), F.col("metadata")
    )
    joined = side_join(accepted, side, ["workspace_id", "meter_name"], residual=residual)
    return joined.select("workspace_id", "rule_id").distinct()
