"""Time expressions on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by the wall clock, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts)


def whole_days(first: Column, last: Column) -> Column:
    """Full 24-hour spans between two timestamps (not calendar days)."""
    return F.floor(F.timestamp_diff("MICROSECOND", first, last) / F.lit(MICROS_PER_DAY))


def per_day(count: Column, first: Column, last: Column) -> Column:
    days = F.greatest(whole_days(first, last), F.lit(1))
    return F.coalesce(count.cast("double") / days, F.lit(0.0))


def entropy_of(counts: list[Column]) -> Column:
    """Base-2 entropy of a histogram given as one column per bin; 0 when it is empty."""
    total = sum(counts[1:], counts[0]).cast("double")
    terms = []
    for count in counts:
        share = count / total
        terms.append(F.when(count > 0, -share * F.log2(share)).otherwise(F.lit(0.0)))
    return sum(terms[1:], terms[0])
