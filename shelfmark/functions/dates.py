"""Years, reset times and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plausible imprint year.
FIRST_YEAR, LAST_YEAR = 1000, 2100
# Points lost for each year beyond the tolerance, and at most.
YEAR_RATE, YEAR_MOST = 0.5, 25.0


def extract_year(text: Column) -> Column:
    """The first plausible four-digit year that stands alone, else null."""
    runs = F.regexp_extract_all(text.cast("string"), F.lit(r"(?U)\b([0-9]{4})\b"), F.lit(1))
    return F.get(F.filter(F.transform(runs, lambda y: y.cast("int")), lambda y: y.between(FIRST_YEAR, LAST_YEAR)), F.lit(0))


def year_penalty(candidate: Column, wanted: Column, tolerance: int = 0) -> Column:
    """Points lost for years apart; 0 where either is unknown."""
    apart = F.abs(candidate - wanted) - F.greatest(F.lit(0), F.lit(tolerance))
    return F.coalesce(F.least(F.lit(YEAR_MOST), F.greatest(F.lit(0), apart) * F.lit(YEAR_RATE)), F.lit(0.0))


def instant(text: Column) -> Column:
    """A timestamp from ISO text, naive text as UTC; unreadable text gives null."""
    return F.try_to_timestamp(text)


def reset_time(start: Column, hours: Column) -> Column:
    return start + F.make_dt_interval(hours=hours.cast("int"))


def seconds_until(moment: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(moment) - F.unix_timestamp(now))


def backoff(attempt: Column, base: float, multiplier: float, most: float) -> Column:
    """Seconds to wait after the given attempt (from 1)."""
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt - 1), F.lit(most))


def retry_after(header: Column, now: Column, most: float) -> Column:
    """Seconds a Retry-After header asks for, between 0 and ``most``; null where it says nothing."""
    number = F.try_cast(header, "double") if hasattr(F, "try_cast") else header.try_cast("double")
    dated = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(number, (F.unix_timestamp(dated) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(0.0), seconds)))
