"""Keyset pages: seek past the last row seen, never an offset.

Each page is a filter plus `orderBy().limit()`, which Spark runs as a per-partition
top-k. One extra row is fetched to tell whether another page follows.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timecalc import ntz

# (column, ascending)
Order = list[tuple[str, bool]]


def _literal(value: Any) -> Column:
    return ntz(value) if isinstance(value, datetime) else F.lit(value)


def seek(order: Order, after: tuple) -> Column:
    """Rows strictly behind `after` in the given mixed-direction order."""
    test = F.lit(False)
    equal_so_far = F.lit(True)
    for (name, ascending), value in zip(order, after):
        literal = _literal(value)
        beyond = F.col(name) > literal if ascending else F.col(name) < literal
        test = test | (equal_so_far & beyond)
        equal_so_far = equal_so_far & (F.col(name) == literal)
    # The leading column alone gives a range test that can reach the scan.
    (lead, ascending), value = order[0], after[0]
    bound = F.col(lead) >= _literal(value) if ascending else F.col(lead) <= _literal(value)
    return bound & test


def page(rows: DataFrame, order: Order, limit: int, after: tuple | None = None) -> DataFrame:
    """The next `limit + 1` rows after the cursor; the extra row signals a next page."""
    if after is not None:
        rows = rows.filter(seek(order, after))
    columns = [F.asc(name) if ascending else F.desc(name) for name, ascending in order]
    return rows.orderBy(*columns).limit(limit + 1)


EVENT_ORDER: Order = [("event_time", False), ("id", False)]
LOG_ORDER: Order = [("created_at", False), ("id", False)]
METER_ORDER: Order = [("name", True)]
SUBJECT_ORDER: Order = [("last_event_at", False), ("subject", True)]


def event_page(events: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Raw events, newest first."""
    return page(events, EVENT_ORDER, limit, after)


def log_page(log: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Runs, alert events or entitlement events, newest first."""
    return page(log, LOG_ORDER, limit, after)


def meter_page(meters: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Meters by name."""
    return page(meters, METER_ORDER, limit, after)


def subject_page(stats: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Subjects by newest event, then name."""
    return page(stats, SUBJECT_ORDER, limit, after)


def subject_events(events: DataFrame, subject: str, limit: int) -> DataFrame:
    """The newest events of one subject."""
    rows = events.filter(F.col("subject") == subject)
    return rows.orderBy(F.desc("event_time"), F.desc("id")).limit(limit)


def walk(rows: DataFrame, order: Order, limit: int):
    """All pages in turn, each as `(rows, next cursor or None)`."""
    cursor = None
    while True:
        got = page(rows, order, limit, cursor).collect()
        kept = got[:limit]
        cursor = tuple(kept[-1][name] for name, _ in order) if len(got) > limit else None
        yield kept, cursor
        if cursor is None:
            return
