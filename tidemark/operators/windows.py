"""The query functions over frames of sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import div
from tidemark.model import GROUP_SECONDS, InvalidArgValue, PhiOutOfRange

_BUCKET = 86_400


def coalesce(tier, frame: DataFrame) -> DataFrame:
    """All windows as one that spans them; none from none."""
    return tier.merge_all(frame)


def group(tier, frame: DataFrame, unit: str) -> DataFrame:
    """Windows whose starts lie in one second, hour or day (UTC) as one. The result spans its windows, not the calendar."""
    if unit not in GROUP_SECONDS:
        raise InvalidArgValue("Group must be either seconds, hours, or days")
    return tier.merge(frame, div(F.col("window_start"), GROUP_SECONDS[unit]))


def islands(windows: DataFrame) -> DataFrame:
    """``windows`` (window_start, window_end, ...) with ``island``: windows that overlap, also through others, get one, named
    by its first start. Touching windows don't overlap.

    Days are swept in parallel; what a day needs of those before it is the furthest end and the last start of an island,
    carried over by a sweep over one row per day.
    """
    w = windows.withColumn("day", div(F.col("window_start"), _BUCKET))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("day").orderBy("window_start", "window_end")
    reach = w.groupBy("day").agg(F.max("window_end").alias("far")).select("day", F.max("far").over(before).alias("reach"))
    w = w.join(reach, "day")
    furthest = F.greatest("reach", F.max("window_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("opens", F.when(furthest.isNull() | (F.col("window_start") >= furthest), F.col("window_start")))
    carried = w.groupBy("day").agg(F.max("opens").alias("latest")).select("day", F.max("latest").over(before).alias("carried"))
    w = w.join(carried, "day")
    # by range, so windows with one start share what any of them opens, in whatever order they come
    upto = Window.partitionBy("day").orderBy("window_start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max("opens").over(upto)
    return w.select(*windows.columns, F.coalesce(own, "carried").alias("island"))


def combine(tier, frames: list[DataFrame]) -> DataFrame:
    """The union of several series, overlapping windows merged within and across them. A series that occurs twice counts twice.

    Islands are found on the windows' bounds alone; payloads are read once and get their island by series and window.
    """
    every = reduce(DataFrame.unionByName, [f.withColumn("series", F.lit(k)) for k, f in enumerate(frames)])
    tied = islands(tier.spans(every, "series", "wid")).select("series", "wid", "island")
    return tier.merge(every.join(tied, ["series", "wid"]).drop("series"), F.col("island"))


def quantile(tier, frame: DataFrame, phis: list[float], repeats: bool = True) -> DataFrame:
    """Quantiles of every window, in the order of the phis; repeated phis give repeated rows. ``repeats``: see ``ranked``."""
    for phi in phis:
        if not 0 < phi < 1:
            raise PhiOutOfRange(phi)
    return tier.quantiles(frame, phis, repeats)
