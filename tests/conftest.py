import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from sample_values import at  # noqa: E402

from meterframe.schema import ASSIGNMENT, METER, PLAN, PLAN_LIMIT, RAW_EVENT, USAGE_EVENT  # noqa: E402
from meterframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Small tables from dictionaries; missing columns are NULL or a usable default."""

    class Make:
        def _frame(self, rows, schema, defaults):
            names = [part.strip().split(" ")[0].strip("`") for part in _split(schema)]
            data = [tuple({**defaults, **row}.get(name) for name in names) for row in rows]
            return spark.createDataFrame(data, schema)

        def usage(self, *rows):
            rows = [
                {"id": f"e{i:03d}", "received_at": row["event_time"], **row} for i, row in enumerate(rows)
            ]
            defaults = {"workspace_id": "ws", "subject": "org_123", "meter_name": "api_calls", "metadata": "{}"}
            return self._frame(rows, USAGE_EVENT, defaults)

        def raw(self, *rows):
            rows = [{"index": i, **row} for i, row in enumerate(rows)]
            defaults = {"workspace_id": "ws", "subject": "org_123", "meter": "api_calls", "quantity": 1.0}
            return self._frame(rows, RAW_EVENT, defaults)

        def meters(self, *rows):
            defaults = {
                "workspace_id": "ws",
                "name": "api_calls",
                "unit": "call",
                "aggregation": "sum",
                "dimensions": [],
                "event_retention_days": 90,
                "created_at": at("2026-01-01"),
            }
            rows = [{"id": f"m{i}", **row} for i, row in enumerate(rows or [{}])]
            return self._frame(rows, METER, defaults)

        def plans(self, *rows):
            defaults = {
                "workspace_id": "ws",
                "name": "Pro",
                "version": 1,
                "is_current": True,
                "created_at": at("2026-01-01"),
                "updated_at": at("2026-01-01"),
            }
            return self._frame(rows, PLAN, defaults)

        def limits(self, *rows):
            defaults = {
                "workspace_id": "ws",
                "plan_id": "p1",
                "meter_name": "api_calls",
                "period": "month",
                "limit_value": 10.0,
                "warning_percent": 80.0,
            }
            return self._frame(rows, PLAN_LIMIT, defaults)

        def assignments(self, *rows):
            rows = [
                {
                    "id": f"a{i}",
                    "period_anchor_at": row["assigned_at"],
                    "updated_at": row["assigned_at"],
                    **row,
                }
                for i, row in enumerate(rows)
            ]
            return self._frame(rows, ASSIGNMENT, {"workspace_id": "ws", "subject": "org_123", "plan_id": "p1"})

        def frame(self, rows, schema, **defaults):
            return self._frame(rows, schema, defaults)

    return Make()


def _split(schema: str) -> list[str]:
    """Split a schema text on its top-level commas."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(schema):
        depth += char == "<"
        depth -= char == ">"
        if char == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]
