"""Bucket edges, anchored period windows and time text, all on `timestamp_ntz`.

Everything here goes through dates and day-time intervals, so no expression
depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.schema import BUCKET_SIZES, PERIODS

NTZ = "timestamp_ntz"


def utc_naive(value: str | datetime) -> datetime:
    """RFC 3339 text or a datetime as a naive UTC datetime (microseconds)."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.strip())
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def ntz(value: str | datetime) -> Column:
    """A foldable NTZ literal, so parquet filters on it push down."""
    return F.lit(utc_naive(value).isoformat(sep=" ")).cast(NTZ)


def start_of_day(ts: Column) -> Column:
    return F.to_date(ts).cast(NTZ)


def time_of_day(ts: Column) -> Column:
    """The part after midnight, as a day-time interval."""
    return ts - start_of_day(ts)


def bucket_start(ts: Column, size: str) -> Column:
    """Start of the UTC hour, day or month holding `ts`."""
    if size == "hour":
        return start_of_day(ts) + F.make_dt_interval(hours=F.hour(ts))
    if size == "day":
        return start_of_day(ts)
    if size == "month":
        return F.trunc(F.to_date(ts), "MM").cast(NTZ)
    raise ValueError(f"bucket size must be one of {BUCKET_SIZES}: {size!r}")


def bucket_seconds(start: Column, size: str) -> Column:
    """Bucket length in seconds; months have their real length."""
    if size == "hour":
        return F.lit(3600.0)
    if size == "day":
        return F.lit(86400.0)
    day = F.to_date(start)
    return (F.datediff(F.add_months(day, 1), day) * 86400).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    """`end - start` in seconds, exact to the microsecond."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def as_instant(ts: Column) -> Column:
    """A UTC wall-clock value as an instant (`timestamp`), whatever the session zone."""
    micros = (ts - ntz("1970-01-01T00:00:00Z")).cast("interval second").cast("decimal(18,6)") * 1_000_000
    return F.timestamp_micros(micros.cast("bigint"))


def from_instant(instant: Column) -> Column:
    """The UTC wall-clock value of an instant, whatever the session zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return ntz("1970-01-01T00:00:00Z") + F.make_dt_interval(secs=seconds)


def truncated_to_second(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19).cast(NTZ)


def rfc3339(ts: Column) -> Column:
    """`2024-01-31T10:00:00Z`, whole seconds."""
    return F.concat(F.replace(F.substring(ts.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def rfc3339_nano(ts: Column) -> Column:
    """With the fraction, but without its trailing zeros."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


# --- anchored periods ---------------------------------------------------------
#
# A period chain starts at an anchor and repeatedly adds one day, week, month or
# year. Calendar addition overflows instead of clamping (Jan 31 + 1 month = Mar 3)
# and the next step continues from the overflowed date. Overflow can happen only
# once: it lands on day 1 to 3, which every month has. So a month or year chain is
# two plain `add_months` chains: from the anchor, and from the overflowed date after
# a known number of steps. Window edges are therefore plain date arithmetic, with no
# enumeration of windows and no range join.
#
# The steps are separate projections, which keeps each expression small enough for
# whole-stage code generation.


def _month_overflow_step(day: Column) -> Column:
    """How many monthly steps from date `day` until its day is missing; NULL if never."""
    dom = F.dayofmonth(day)
    month = F.month(day)
    # Day 31: the next month unless that one has 31 days too (July, December).
    step_31 = F.when(month.isin(7, 12), 2).otherwise(1)
    # Day 30: the next February.
    to_february = F.pmod(F.lit(13) - month, F.lit(12)) + 1
    # Day 29: the next February without a leap day (leap years are never adjacent).
    february_end = F.last_day(F.add_months(F.trunc(day, "MM"), to_february))
    step_29 = to_february + F.when(F.dayofmonth(february_end) == 29, 12).otherwise(0)
    return F.when(dom == 31, step_31).when(dom == 30, to_february).when(dom == 29, step_29)


def _year_overflow_step(day: Column) -> Column:
    return F.when((F.month(day) == 2) & (F.dayofmonth(day) == 29), 1)


def _overflow_date(day: Column, months: Column) -> Column:
    """`day` plus `months` with calendar overflow into the following month."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


WIDTH = {"day": 1, "week": 7, "month": 1, "year": 12}


def _with_chain(df: DataFrame, anchor: str, periods: list[str]) -> DataFrame:
    """Adds the anchor's date and time of day, and where month and year chains overflow."""
    unknown = [p for p in periods if p not in PERIODS]
    if unknown:
        raise ValueError(f"period must be one of {PERIODS}: {unknown[0]!r}")
    df = df.withColumns({"__day": F.to_date(anchor), "__tod": time_of_day(F.col(anchor))})
    steps = {}
    if "month" in periods:
        steps["__month_step"] = _month_overflow_step(F.col("__day"))
    if "year" in periods:
        steps["__year_step"] = _year_overflow_step(F.col("__day"))
    if not steps:
        return df
    df = df.withColumns(steps)
    return df.withColumns(
        {
            name.replace("step", "base"): _overflow_date(
                F.col("__day"), F.col(name) * WIDTH[name.strip("_").split("_")[0]]
            )
            for name in steps
        }
    )


def _boundary(period: str, n: Column) -> Column:
    """The n-th boundary; needs the columns of `_with_chain`."""
    day, width = F.col("__day"), WIDTH[period]
    if period in ("day", "week"):
        date = F.date_add(day, (n * width).cast("int"))
    else:
        step, base = F.col(f"__{period}_step"), F.col(f"__{period}_base")
        overflowed = F.add_months(base, ((n - step) * width).cast("int"))
        date = F.when(n >= step, overflowed).otherwise(F.add_months(day, (n * width).cast("int")))
    return date.cast(NTZ) + F.col("__tod")


def with_period_index(df: DataFrame, ts: Column, periods: list[str], anchor: str) -> DataFrame:
    """Adds `__<period>_n`, the index of the window holding `ts` (0 before the anchor)."""
    df = _with_chain(df, anchor, periods).withColumn("__ts", ts)
    moment, day = F.col("__ts"), F.col("__day")
    steps = {}
    for period in periods:
        if period in ("day", "week"):
            days = F.datediff(F.to_date(moment), day) - (time_of_day(moment) < F.col("__tod")).cast("int")
            steps[f"__{period}_n"] = F.greatest(F.floor(days / WIDTH[period]).cast("int"), F.lit(0))
        else:
            base = F.col(f"__{period}_base")
            on_base = F.coalesce(moment >= base.cast(NTZ) + F.col("__tod"), F.lit(False))
            steps[f"__{period}_on_base"] = on_base
    df = df.withColumns(steps)
    calendar = [p for p in periods if p in ("month", "year")]
    if not calendar:
        return df
    # The chain that `ts` lies on, and the whole months (years) since its start.
    chains = {f"__{p}_chain": F.when(F.col(f"__{p}_on_base"), F.col(f"__{p}_base")).otherwise(day) for p in calendar}
    df = df.withColumns(chains)
    guesses = {}
    for period in calendar:
        chain = F.col(f"__{period}_chain")
        years = F.year(moment) - F.year(chain)
        months = years * 12 + F.month(moment) - F.month(chain)
        guesses[f"__{period}_guess"] = years if period == "year" else months
    df = df.withColumns(guesses)
    indexes = {}
    for period in calendar:
        chain, guess = F.col(f"__{period}_chain"), F.col(f"__{period}_guess")
        reached = F.add_months(chain, guess * WIDTH[period]).cast(NTZ) + F.col("__tod") <= moment
        done = F.greatest(F.when(reached, guess).otherwise(guess - 1), F.lit(0))
        step = F.col(f"__{period}_step")
        # Before the overflow the last plain step is `step - 1` (`least` skips NULL).
        indexes[f"__{period}_n"] = F.when(F.col(f"__{period}_on_base"), step + done).otherwise(
            F.least(done, step - 1)
        )
    return df.withColumns(indexes)


def with_windows(
    df: DataFrame, ts: Column, periods: list[str] = PERIODS, anchor: str = "period_anchor_at"
) -> DataFrame:
    """Adds `<period>_window`, a struct of `period_start` and `period_end`, per period.

    The window holds `ts`; it is the first one when `ts` lies before the anchor.
    """
    columns = df.columns
    df = with_period_index(df, ts, periods, anchor)
    windows = [
        F.struct(
            _boundary(p, F.col(f"__{p}_n")).alias("period_start"),
            _boundary(p, F.col(f"__{p}_n") + 1).alias("period_end"),
        ).alias(f"{p}_window")
        for p in periods
    ]
    return df.select(*columns, *windows)


def with_window_of(df: DataFrame, ts: Column, period: str = "period", anchor: str = "period_anchor_at") -> DataFrame:
    """Adds `period_start` and `period_end` for the period named in a column."""
    columns = df.columns
    placed = with_windows(df, ts, PERIODS, anchor)
    picked = F.when(F.col(period) == PERIODS[0], F.col(f"{PERIODS[0]}_window"))
    for name in PERIODS[1:]:
        picked = picked.when(F.col(period) == name, F.col(f"{name}_window"))
    return placed.select(*columns, picked.alias("w")).select(*columns, "w.period_start", "w.period_end")


def windows_until(df: DataFrame, until: Column, periods: list[str], anchor: str = "period_anchor_at") -> DataFrame:
    """One row per window that starts before `until`; always at least the first one."""
    columns = df.columns
    last_moment = until - F.expr("INTERVAL 0.000001 SECOND")
    indexed = with_period_index(df, last_moment, periods, anchor)
    result = None
    for period in periods:
        numbered = indexed.withColumn("__n", F.explode(F.sequence(F.lit(0), F.col(f"__{period}_n"))))
        rows = numbered.select(
            *columns,
            F.lit(period).alias("period"),
            _boundary(period, F.col("__n")).alias("period_start"),
            _boundary(period, F.col("__n") + 1).alias("period_end"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def day_index(ts: Column, anchor: Column) -> Column:
    """Index of the day window of `anchor` that holds `ts`."""
    return F.datediff(F.to_date(ts), F.to_date(anchor)) - (time_of_day(ts) < time_of_day(anchor)).cast("int")


def day_boundary(anchor: Column, n: Column) -> Column:
    """Start of the n-th day window of `anchor`."""
    return F.date_add(F.to_date(anchor), n).cast(NTZ) + time_of_day(anchor)
