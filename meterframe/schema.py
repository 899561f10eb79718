"""Table schemas. Times are `timestamp_ntz` holding UTC wall-clock values.

NTZ keeps bucket edges, parquet filters and comparisons independent of the
session time zone.
"""

from __future__ import annotations

USAGE_EVENT = (
    "id string, workspace_id string, idempotency_key string, subject string, "
    "meter_name string, quantity double, event_time timestamp_ntz, "
    "received_at timestamp_ntz, metadata string"
)

EVENT_COLUMNS = [
    "id",
    "workspace_id",
    "idempotency_key",
    "subject",
    "meter_name",
    "quantity",
    "event_time",
    "received_at",
    "metadata",
]

RAW_EVENT = (
    "index long, id string, workspace_id string, idempotency_key string, "
    "subject string, meter string, quantity double, `timestamp` timestamp_ntz, "
    "metadata string"
)

DIMENSION = (
    "struct<name:string,display_name:string,description:string,type:string,"
    "required:boolean,deprecated:boolean>"
)

METER = (
    "id string, workspace_id string, name string, description string, unit string, "
    f"aggregation string, dimensions array<{DIMENSION}>, event_retention_days int, "
    "created_at timestamp_ntz"
)

PLAN = (
    "id string, workspace_id string, name string, description string, version int, "
    "parent_plan_id string, is_current boolean, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)

PLAN_LIMIT = (
    "workspace_id string, plan_id string, meter_name string, period string, "
    "limit_value double, warning_percent double"
)

ASSIGNMENT = (
    "id string, workspace_id string, subject string, plan_id string, "
    "assigned_at timestamp_ntz, period_anchor_at timestamp_ntz, "
    "unassigned_at timestamp_ntz, updated_at timestamp_ntz"
)

ALERT_RULE = (
    "rule_id string, workspace_id string, name string, meter_name string, "
    "enabled boolean, subject string, metadata map<string,string>, "
    "window_seconds long, comparator string, threshold double, "
    "evaluation_interval_seconds long, group_by string, next_evaluate_at timestamp_ntz"
)

ALERT_STATE = (
    "workspace_id string, rule_id string, group_key string, group_value string, status string, "
    "value double, message string, evaluated_at timestamp_ntz, updated_at timestamp_ntz"
)

INGESTION_RUN = (
    "id string, workspace_id string, kind string, accepted long, duplicates long, "
    "failed long, created_at timestamp_ntz"
)

# Fixed values of the data model.
AGGREGATIONS = ["sum", "count", "avg", "min", "max", "first", "last", "rate"]
DIMENSION_TYPES = ["string", "number", "boolean"]
BUCKET_SIZES = ["hour", "day", "month"]
PERIODS = ["day", "week", "month", "year"]
COMPARATORS = ["gt", "gte", "lt", "lte", "eq", "neq"]
SUBJECT_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"
SUBJECT_MAX_BYTES = 128
DIMENSION_NAME_PATTERN = r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*$"
NAME_MAX_CHARS = 120
RETENTION_DEFAULT_DAYS = 90
RETENTION_MAX_DAYS = 3650
WARNING_DEFAULT_PERCENT = 80.0
MISSING_GROUP = "<nil>"
