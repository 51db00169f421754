"""Parsing of posted dates with the seven accepted formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgeflow.functions.text import col

# Each accepted format as (exact-shape guard, Spark pattern).  Input is cut to
# 19 characters first, so the fractional-seconds format can never match and is
# absent here.  Guards make parsing whole-string and digit-width exact.
_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)


def posted_ts(date_posted="date_posted") -> Column:
    """Timestamp of a raw posted date, or null when no format fits."""
    # a space in a format matches any run of whitespace
    s = F.regexp_replace(F.substring(col(date_posted), 1, 19), r"\s+", " ")
    return F.coalesce(*[F.when(s.rlike(guard), F.try_to_timestamp(s, F.lit(fmt)))
                        for guard, fmt in _FORMATS])


def as_of_ts(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def hours_before(as_of: str, hours: int) -> Column:
    return as_of_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def days_before(as_of: str, days: int) -> Column:
    return as_of_ts(as_of) - F.make_dt_interval(F.lit(int(days)))
