"""Date predicates given as text: prefixes and lexicographic comparisons that reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bounds(p: str) -> tuple[dt.date, dt.date] | None:
    """First day and day after the last day of 'yyyy', 'yyyy-MM' or 'yyyy-MM-dd'."""
    try:
        if len(p) == 4:
            return dt.date(int(p), 1, 1), dt.date(int(p) + 1, 1, 1)
        if len(p) == 7:
            first = dt.date(int(p[:4]), int(p[5:]), 1)
            return first, (first + dt.timedelta(days=31)).replace(day=1)
        if len(p) == 10:
            day = dt.date.fromisoformat(p)
            return day, day + dt.timedelta(days=1)
    except ValueError:
        pass
    return None


def _stamp(d: dt.date) -> Column:
    return F.expr(f"timestamp_ntz'{d.isoformat()} 00:00:00'")


def date_prefix(col: Column | str, prefix: str) -> Column:
    """Whether the date, written yyyy-MM-dd, starts with ``prefix``.

    Years, months and days become a half-open range, which Parquet can skip by;
    other prefixes compare the text.
    """
    col = F.col(col) if isinstance(col, str) else col
    span = _bounds(prefix)
    if span is None:
        return F.date_format(col, "yyyy-MM-dd").startswith(prefix)
    return (col >= _stamp(span[0])) & (col < _stamp(span[1]))


def date_after(col: Column | str, bound: str) -> Column:
    """Whether the date, written yyyy-MM-dd, is greater than ``bound`` as text."""
    col = F.col(col) if isinstance(col, str) else col
    span = _bounds(bound)
    if span is None:
        return F.date_format(col, "yyyy-MM-dd") > F.lit(bound)
    return col >= _stamp(span[1] if len(bound) == 10 else span[0])


def month(col: Column | str) -> Column:
    """yyyy-MM."""
    return F.date_format(col, "yyyy-MM")


def day(col: Column | str) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(col, "yyyy-MM-dd")
