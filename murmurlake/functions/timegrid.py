"""Time buckets, gap-free grids, labelled periods and halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = {"hour": "INTERVAL '1' HOUR", "day": "INTERVAL '1' DAY"}


def bucket(ts: Column | str, unit: str) -> Column:
    """The start of the hour or day, without a time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def window_start(ts: Column | str, hours: int) -> Column:
    """The start of the window of so many hours (a divisor of 24)."""
    if 24 % hours:
        raise ValueError("windows must divide a day")
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    return day + F.make_dt_interval(hours=(F.floor(F.hour(ts) / hours) * hours).cast("int"))


def grid(bounds: DataFrame, low: str, high: str, step: str, name: str) -> DataFrame:
    """Every step from ``low`` to ``high`` of a one-row frame; no rows if they are null."""
    return bounds.where(F.col(low).isNotNull()).select(F.explode(F.sequence(low, high, F.expr(step))).alias(name))


def fill_gaps(counted: DataFrame, time: str, step: str, zeros: list[str], low: Column | None = None, high: Column | None = None) -> DataFrame:
    """``counted`` with a row for every step between its first and last, ``zeros`` being 0 where it had none."""
    bounds = counted.agg((F.min(time) if low is None else low).alias("lo"), (F.max(time) if high is None else high).alias("hi"))
    return grid(bounds, "lo", "hi", step, time).join(counted, time, "left").fillna(0, zeros)


def period_index(ts: Column, low: Column, high: Column, periods: int) -> Column:
    """Which of ``periods`` equally wide, right-closed bins a time is in, from 1; all in one without any width."""
    span = F.expr("1D") * (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp")))
    part = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) * periods / F.nullif(span, F.lit(0.0))
    return F.greatest(F.lit(1), F.least(F.lit(periods), F.ceil(F.coalesce(part, F.lit(1.0))).cast("int"))).cast("int")


def period_label(start: Column, end: Column) -> Column:
    """How a period is written, by what its ends share; labels may collide, so keys are the period's number."""
    same = lambda pattern: F.date_format(start, pattern) == F.date_format(end, pattern)
    return (
        F.when(same("yyyy-MM-dd"), F.date_format(start, "MMM dd"))
        .when(same("yyyy-MM"), F.concat(F.date_format(start, "MMM dd"), F.lit("–"), F.date_format(end, "dd")))
        .when(same("yyyy"), F.concat(F.date_format(start, "MMM dd"), F.lit("–"), F.date_format(end, "MMM dd")))
        .otherwise(F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("–"), F.date_format(end, "yyyy-MM-dd")))
    )


def gap_label(minutes: Column) -> Column:
    """Minutes as ``12m``, ``3.5h`` or ``2.0d``."""
    return F.when(minutes < 60, F.format_string("%dm", minutes.cast("bigint"))).when(minutes < 1440, F.format_string("%.1fh", minutes / 60)).otherwise(F.format_string("%.1fd", minutes / 1440))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes from one time to another; negative if they are the other way round, null if either is."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 6e7
