"""

All helpers return ``Column`` objects built from built-in functions: no Python UDF sits in
any hot path, so every projection stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "pct", "rate_pct", "lower_eq", "is_attended", "is_failed", "is_passed",
    "week_ending_monday", "week_start_monday", "month_start", "micros_between", "day_number", "hours_between",
    "whole_days_between", "floor_ntz", "parse_ts", "clip_upper", "clip_lower", "title_case", "sum0",
    "DEFAULT_TS_FORMATS",
]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(num: str | Column, den: str | Column) -> Column:
    """num / den * 100 as double; NULL when the denominator is 0 (ANSI-safe)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double")) * F.lit(100.0)


def rate_pct(flag: Column, denominator: Column | None = None) -> Column:
    """Aggregate: share of rows where ``flag`` is true ×100 (A3/A4).

    ``denominator`` defaults to all rows; pass ``F.count('record_id')`` for the per-key rate
    whose denominator is non-null record ids.
    """
    den = F.count(F.lit(1)) if denominator is None else denominator
    return pct(F.count_if(flag), den)


def lower_eq(c: str | Column, value: str) -> Column:
    """Case-insensitive equality that is false (never NULL) on NULL input (P6, §1.3)."""
    return F.coalesce(F.lower(col_(c)) == F.lit(value), F.lit(False))


def is_attended(c: str | Column = "status") -> Column:
    return lower_eq(c, "attended")


def is_failed(c: str | Column = "mastery_status") -> Column:
    return lower_eq(c, "failed")


def is_passed(c: str | Column = "mastery_status") -> Column:
    return lower_eq(c, "passed")


def week_ending_monday(ts: str | Column) -> Column:
    """Weekly bucket Tuesday..Monday labelled by its Monday (pandas ``W-MON``)."""
    return F.next_day(F.date_sub(F.to_date(col_(ts)), 1), "MON")


def week_start_monday(ts: str | Column) -> Column:
    """Monday on or before the timestamp, as a date (period ``W`` start)."""
    d = F.to_date(col_(ts))
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)


def month_start(ts: str | Column) -> Column:
    return F.trunc(F.to_date(col_(ts)), "MM")


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed microseconds; for wall-clock (NTZ) timestamps no zone or DST is involved."""
    return F.timestamp_diff("MICROSECOND", col_(start), col_(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Fractional hours from ``start`` to ``end`` (negative when end is earlier)."""
    return micros_between(start, end).cast("double") / F.lit(3600e6)


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Whole days from ``start`` to ``end``, floored like ``Timedelta.days``."""
    return F.floor(micros_between(start, end) / F.lit(86400e6)).cast("bigint")


def day_number(ts: str | Column) -> Column:
    """Days since 1970-01-01 of the timestamp's calendar date (zone-free for NTZ)."""
    return F.datediff(F.to_date(col_(ts)), F.lit("1970-01-01").cast("date"))


DEFAULT_TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm",
                      "dd/MM/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def floor_ntz(ts: str | Column, unit: str) -> Column:
    """Floor a wall-clock timestamp to the minute or second, staying TIMESTAMP_NTZ and
    zone-free (``date_trunc`` would pass through the session zone and return LTZ)."""
    c = col_(ts)
    sec = F.second(c) if unit == "second" else F.lit(0)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), sec)


def parse_ts(c: str | Column, formats: tuple[str, ...] = DEFAULT_TS_FORMATS) -> Column:
    """Text → timestamp, trying each accepted format; bad text → NULL (never raises).

    Columns that already hold timestamps pass through unchanged by the caller.
    """
    return F.coalesce(*[F.try_to_timestamp(col_(c), F.lit(f)) for f in formats])


def clip_upper(c: str | Column, cap: Column) -> Column:
    """``Series.clip(upper=cap)``; NULL stays NULL (``least`` would skip it)."""
    c = col_(c)
    return F.when(c.isNull(), None).otherwise(F.least(c, cap))


def clip_lower(c: str | Column, floor_: Column) -> Column:
    c = col_(c)
    return F.when(c.isNull(), None).otherwise(F.greatest(c, floor_))


def title_case(c: str | Column) -> Column:
    """``str.title()``: every letter after a non-letter is upper-cased, the rest lower.

    ``initcap`` only splits on spaces (``mid-term`` → ``Mid-term``); this splits on any
    non-letter, as Python does (``Mid-Term``).
    """
    parts = F.regexp_extract_all(F.lower(col_(c)), F.lit("([^a-z]*[a-z]*)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(
        F.regexp_extract(p, "^([^a-z]*)", 1),
        F.upper(F.substring(F.regexp_replace(p, "^[^a-z]*", ""), 1, 1)),
        F.substr(F.regexp_replace(p, "^[^a-z]*", ""), F.lit(2)))), "")


def sum0(c: str | Column) -> Column:
    """Sum that is 0.0 over an all-NULL or empty group (pandas ``sum``)."""
    return F.coalesce(F.sum(col_(c)), F.lit(0.0))
