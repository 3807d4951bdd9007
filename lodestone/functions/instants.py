"""Instants of ISO timestamp strings, exact below a millisecond.

Timestamps stay the raw source strings; an instant is derived only to compare.
It is (UTC second, fraction digits without trailing zeros), because a Spark
timestamp stops at microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spelling of a ``since`` bound.
SINCE_FORM = re.compile(
    r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?"
)
_PARTS = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?)?$"
)


def check_since(value: str) -> str:
    if not SINCE_FORM.fullmatch(value):
        raise ValueError(f"since must be an ISO 8601 date or timestamp, got {value}")
    return value


def instant_sec(ts: Column) -> Column:
    """The whole UTC second, NULL where the string is not a timestamp."""
    part = lambda i: F.regexp_extract(ts, _PARTS, i)
    clock = F.when(part(2) == "", F.lit("00:00:00")).otherwise(
        F.concat(part(2), F.when(part(3) == "", F.lit(":00")).otherwise(part(3)))
    )
    zone = F.when(part(5).isin("", "Z"), F.lit("+00:00")).otherwise(
        F.regexp_replace(part(5), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    )
    return F.when(
        part(1) != "", F.try_to_timestamp(F.concat(part(1), F.lit("T"), clock, zone))
    )


def instant_frac(ts: Column) -> Column:
    return F.rtrim(F.regexp_extract(ts, _PARTS, 4), F.lit("0"))


def instant_micros(ts: Column) -> Column:
    """Epoch microseconds (fraction cut at six digits), for distances in time."""
    return F.unix_micros(instant_sec(ts)) + F.rpad(
        F.substring(F.regexp_extract(ts, _PARTS, 4), 1, 6), 6, "0"
    ).cast("long")


def since(ts: Column, bound: str) -> Column:
    """``ts`` at or after ``bound`` as instants; other strings and NULL drop."""
    b = F.lit(check_since(bound))
    sec, bsec = instant_sec(ts), instant_sec(b)
    return (sec > bsec) | ((sec == bsec) & (instant_frac(ts) >= instant_frac(b)))


def age_days(ts: Column, now: Column) -> Column:
    """Whole days from ``ts`` to ``now``, at least 0; 0 where ``ts`` is no timestamp."""
    return F.coalesce(
        F.greatest(F.lit(0), F.floor((F.unix_micros(now) - instant_micros(ts)) / F.lit(86_400_000_000))),
        F.lit(0),
    ).cast("long")


def date_range(first: Column, last: Column) -> Column:
    """``from → to`` of the date prefixes; one date where they agree or one is missing."""
    a, b = F.substring(first, 1, 10), F.substring(last, 1, 10)
    return (
        F.when(F.coalesce(a, F.lit("")) == "", b)
        .when((F.coalesce(b, F.lit("")) == "") | (a == b), a)
        .otherwise(F.concat(a, F.lit(" → "), b))
    )
