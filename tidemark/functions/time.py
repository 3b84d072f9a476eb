"""Unix seconds and half-open windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(value: Column, by: int) -> Column:
    """Whole division of 64-bit integers, rounded down."""
    return F.call_function("div", align(value, by), F.lit(by)) if by != 1 else value


def hours(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return div(ts, 3600)


def days(ts: Column) -> Column:
    """Whole days since the epoch."""
    return div(ts, 86_400)


def align(ts: Column, size: int) -> Column:
    """Start of the tumbling window that holds ``ts``."""
    return ts - F.pmod(ts, F.lit(size).cast("long"))


def duration(start: Column, end: Column) -> Column:
    """Length of a window."""
    return end - start


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open windows share an instant; touching ones don't."""
    return (start < other_end) & (other_start < end)


def disjoint(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open windows share nothing."""
    return ~overlaps(start, end, other_start, other_end)
