"""Coarser windows with age, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import TIERS


def tier_width(age: Column) -> Column:
    """Window width for an age in seconds; null beyond the last tier."""
    out = F.lit(None).cast("long")
    for limit, width in reversed(TIERS):
        out = F.when(age < limit, F.lit(width).cast("long")).otherwise(out)
    return out


def plan(windows: DataFrame, now: int) -> DataFrame:
    """``windows`` with action (ignore, discard, expand), new_start and new_end. Future windows are ignored; an expanded
    window never ends earlier than it did."""
    age, start, end = F.lit(now) - F.col("window_start"), F.col("window_start"), F.col("window_end")
    width = tier_width(age)
    grown = F.floor(start / width).cast("long") * width
    far = F.greatest(grown + width, end)
    action = F.when(age < 0, "ignore").when(width.isNull(), "discard").when((grown == start) & (far == end), "ignore").otherwise("expand")
    kept = action == "expand"
    return windows.withColumns({"action": action, "new_start": F.when(kept, grown).otherwise(start), "new_end": F.when(kept, far).otherwise(end)})


def downsample(tier, windows: DataFrame, now: int) -> DataFrame:
    """Stored windows after one pass at ``now``. Kept and expanded windows that share a key merge."""
    rows = plan(windows, now).where("action <> 'discard'")
    moved = rows.drop("window_start", "window_end", "action").withColumnsRenamed({"new_start": "window_start", "new_end": "window_end"})
    return tier.merge_stored(moved.select(*windows.columns))


