"""The registered queries: name -> plan, and name -> SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with the SQL that must give the same rows."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round double columns: the last bits of a float sum depend on the order of rows."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# Usage views in SQL, the counterparts of `sources.tables`.
EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         'ws_' || CAST(user_id % 3 AS VARCHAR) AS workspace_id,
         CAST(user_id AS VARCHAR) || '-' || event_type || '-' || strftime(ts, '%Y-%m-%d %H') AS idempotency_key,
         'user_' || CAST(user_id AS VARCHAR) AS subject,
         event_type AS meter_name,
         value AS quantity,
         ts AS event_time,
         ts + INTERVAL 5 SECOND AS received_at,
         props AS metadata
  FROM events)"""

ORD = """ord AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         'ws_' || CAST(o_custkey % 3 AS VARCHAR) AS workspace_id,
         'c' || CAST(o_custkey AS VARCHAR) AS subject,
         'orders' AS meter_name,
         o_totalprice AS quantity,
         o_orderdate AS event_time,
         o_orderdate AS received_at,
         o_orderpriority AS priority,
         o_orderstatus AS status
  FROM orders)"""

ITM = """itm AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         'ws_' || CAST(l_suppkey % 3 AS VARCHAR) AS workspace_id,
         's' || CAST(l_suppkey AS VARCHAR) AS subject,
         l_quantity AS quantity,
         l_shipdate AS event_time,
         l_returnflag AS flag,
         l_linestatus AS line,
         l_discount AS discount
  FROM lineitem)"""

MET = """met AS (
  SELECT workspace_id || '/' || meter_name AS id, workspace_id, meter_name AS name,
         CASE meter_name WHEN 'click' THEN 'count' WHEN 'signup' THEN 'max' WHEN 'error' THEN 'last' ELSE 'sum' END
           AS aggregation,
         CAST(length(meter_name) * 2 AS INTEGER) AS event_retention_days
  FROM (SELECT DISTINCT workspace_id, meter_name FROM ev))"""
