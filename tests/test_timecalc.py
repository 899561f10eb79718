"""Anchored periods against step-by-step calendar addition, and bucket edges."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from meterframe.functions.timecalc import (
    bucket_seconds,
    bucket_start,
    rfc3339,
    rfc3339_nano,
    seconds_between,
    windows_until,
    with_window_of,
    with_windows,
)
from meterframe.schema import PERIODS


def add_months(value: datetime, months: int) -> datetime:
    """Calendar addition with overflow into the following month."""
    month = value.month - 1 + months
    first = value.replace(year=value.year + month // 12, month=month % 12 + 1, day=1)
    return first + timedelta(days=value.day - 1)


def step(value: datetime, period: str) -> datetime:
    if period == "day":
        return value + timedelta(days=1)
    if period == "week":
        return value + timedelta(days=7)
    return add_months(value, 12 if period == "year" else 1)


def window(anchor: datetime, period: str, now: datetime):
    start, end = anchor, step(anchor, period)
    while now >= end:
        start, end = end, step(end, period)
    return start, end


def cases():
    random = Random(7)
    base = datetime(2019, 1, 1)
    anchors = [datetime(2026, 1, 31, 15, 30), datetime(2024, 2, 29, 8), datetime(2023, 12, 29, 1, 2, 3)]
    anchors += [datetime(y, m, d, 15, 30) for y in (2023, 2024, 2027) for m in (1, 7, 8, 12) for d in (29, 30, 31)]
    anchors += [base + timedelta(seconds=random.randrange(9 * 365 * 86400)) for _ in range(60)]
    rows = []
    for anchor in anchors:
        for _ in range(12):
            now = anchor + timedelta(seconds=random.randrange(-86400 * 40, 86400 * 2600))
            rows.append((anchor, now))
        for period in ("month", "year"):
            edge = anchor
            for _ in range(14 if period == "month" else 5):
                edge = step(edge, period)
                rows += [(anchor, edge), (anchor, edge - timedelta(microseconds=1))]
    return rows


def test_windows_equal_stepwise_addition(spark):
    df = spark.createDataFrame(cases(), "anchor timestamp_ntz, now timestamp_ntz")
    got = with_windows(df, F.col("now"), PERIODS, "anchor").collect()
    for row in got:
        for period in PERIODS:
            assert tuple(row[f"{period}_window"]) == window(row["anchor"], period, row["now"]), (period, row)


def test_window_of_a_period_column(spark):
    rows = [(anchor, now, PERIODS[i % 4]) for i, (anchor, now) in enumerate(cases())]
    df = spark.createDataFrame(rows, "anchor timestamp_ntz, now timestamp_ntz, period string")
    for row in with_window_of(df, F.col("now"), "period", "anchor").collect():
        assert (row["period_start"], row["period_end"]) == window(row["anchor"], row["period"], row["now"]), row


def test_enumerated_windows_form_the_chain(spark):
    anchors = sorted({anchor for anchor, _ in cases()})
    until = datetime(2028, 3, 1)
    df = spark.createDataFrame([(a,) for a in anchors], "period_anchor_at timestamp_ntz")
    rows = windows_until(df, F.lit(until).cast("timestamp_ntz"), ["week", "month", "year"]).collect()
    got = {}
    for row in rows:
        got.setdefault((row["period_anchor_at"], row["period"]), []).append((row["period_start"], row["period_end"]))
    for anchor in anchors:
        for period in ("week", "month", "year"):
            expected, edge = [], anchor
            while edge < until or not expected:
                expected.append((edge, step(edge, period)))
                edge = step(edge, period)
            assert sorted(got[(anchor, period)]) == expected, (anchor, period)


def test_golden_windows(spark):
    rows = [
        (datetime(2026, 6, 20, 15, 30), datetime(2026, 7, 21, 10)),
        (datetime(2026, 6, 20, 15, 30), datetime(2026, 6, 19, 15, 30)),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, t timestamp_ntz")
    got = with_windows(df, F.col("t"), ["month", "week"], "a").collect()
    assert tuple(got[0]["month_window"]) == (datetime(2026, 7, 20, 15, 30), datetime(2026, 8, 20, 15, 30))
    assert tuple(got[1]["week_window"]) == (datetime(2026, 6, 20, 15, 30), datetime(2026, 6, 27, 15, 30))


def test_january_31_drifts_to_the_3rd(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 31, 15, 30),)], "period_anchor_at timestamp_ntz")
    rows = windows_until(df, F.lit(datetime(2026, 5, 20)).cast("timestamp_ntz"), ["month"]).collect()
    assert sorted(r["period_end"] for r in rows) == [datetime(2026, m, 3, 15, 30) for m in (3, 4, 5, 6)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Pacific/Apia"])
def test_buckets_ignore_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The second value lies in New York's spring gap.
        times = [datetime(2024, 2, 10, 13, 14, 15, 500000), datetime(2024, 3, 10, 2, 30)]
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        got = df.select(
            *[bucket_start(F.col("t"), size).alias(size) for size in ("hour", "day", "month")],
            bucket_seconds(bucket_start(F.col("t"), "month"), "month").alias("month_seconds"),
            rfc3339(F.col("t")).alias("text"),
            rfc3339_nano(F.col("t")).alias("nano"),
            seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("t")).alias("seconds"),
        ).collect()
        for row, t in zip(got, times):
            assert row["hour"] == t.replace(minute=0, second=0, microsecond=0)
            assert row["day"] == datetime(t.year, t.month, t.day)
            assert row["month"] == datetime(t.year, t.month, 1)
            assert row["seconds"] == (t - datetime(2024, 1, 1)).total_seconds()
        assert [r["month_seconds"] for r in got] == [29 * 86400.0, 31 * 86400.0]
        assert [r["text"] for r in got] == ["2024-02-10T13:14:15Z", "2024-03-10T02:30:00Z"]
        assert [r["nano"] for r in got] == ["2024-02-10T13:14:15.5Z", "2024-03-10T02:30:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
