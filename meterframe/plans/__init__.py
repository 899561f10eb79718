"""Registered queries over the driver's tables, each next to its SQL oracle."""

from meterframe.plans import alerting, ingestion, quota, streams, usage  # noqa: F401  (they register their queries)
from meterframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
