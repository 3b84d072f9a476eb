"""Metric names and search patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a metric name looks like.
NAME = r"[a-zA-Z][a-zA-Z0-9._-]*"


def is_name(name: str) -> bool:
    """Whether a literal is a metric name."""
    return re.fullmatch(NAME, name) is not None


def valid_name(name: Column) -> Column:
    """Whether a column holds a metric name; null is none."""
    return F.coalesce(name.rlike(rf"\A{NAME}\z"), F.lit(False))


def literal_prefix(pattern: str) -> str:
    """The part of a pattern before its first star."""
    return pattern.split("*", 1)[0]


def matches(name: Column, pattern: str) -> Column:
    """Whole-string match where a star stands for any run of characters and all else for itself.

    The literal prefix is a condition of its own, which the Parquet scan can use to skip row groups.
    """
    if "*" not in pattern:
        return name == F.lit(pattern)
    escaped = re.sub(r"([!%_])", r"!\1", pattern).replace("*", "%")
    prefix = literal_prefix(pattern)
    like = F.like(name, F.lit(escaped), F.lit("!"))
    return name.startswith(prefix) & like if prefix else like
