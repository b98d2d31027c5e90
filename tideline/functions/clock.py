"""Time arithmetic on millisecond integers and calendar columns of panels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND_MS, MINUTE_MS, HOUR_MS, DAY_MS = 1_000, 60_000, 3_600_000, 86_400_000

# Fixed value: epoch numbers above this are microseconds (the exchange changed its unit in 2025).
MICROSECOND_THRESHOLD = 100_000_000_000_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP or, with the session zone at UTC, a TIMESTAMP_NTZ column."""
    return F.unix_millis(ts.cast("timestamp"))


def floor_ms(ts_ms: Column, step: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(step))


def hour_of_day(ts_ms: Column) -> Column:
    return F.floor(F.pmod(ts_ms, F.lit(DAY_MS)) / F.lit(HOUR_MS)).cast("int")


def day_of_week(ts_ms: Column) -> Column:
    """Monday = 0; day 0 of the epoch was a Thursday."""
    return F.pmod(F.floor(ts_ms / F.lit(DAY_MS)) + F.lit(3), F.lit(7)).cast("int")


def utc_date(ts_ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / F.lit(DAY_MS)).cast("int"))


def days_since(ts_ms: Column, origin_ms: int) -> Column:
    return (ts_ms - F.lit(origin_ms)) / F.lit(float(DAY_MS))


def relative_day(ts_ms: Column, origin_ms: int) -> Column:
    return F.floor(days_since(ts_ms, origin_ms)).cast("int")


def normalised_epoch(ts: Column) -> Column:
    """Milliseconds from a column that may hold microseconds."""
    return F.when(ts > F.lit(MICROSECOND_THRESHOLD), F.floor(ts / F.lit(1000))).otherwise(ts).cast("bigint")


def header_ms(seconds: Column, mix_field: Column) -> Column:
    """Block time in ms: whole seconds plus the milliseconds in the field's last two bytes (ignored from 1000 on)."""
    ms = F.conv(F.right(mix_field, F.lit(4)), 16, 10).cast("bigint")
    return seconds * F.lit(1000) + F.when(ms < 1000, ms).otherwise(F.lit(0))


def nominal_elapsed(start: Column, stop: Column, change_block: int, pre_ms: int, post_ms: int) -> Column:
    """Scheduled time between two blocks; the period changes with the interval that follows ``change_block``."""
    slow = F.greatest(F.lit(0), F.least(stop, F.lit(change_block)) - start)
    return slow * F.lit(pre_ms) + (stop - start - slow) * F.lit(post_ms)
