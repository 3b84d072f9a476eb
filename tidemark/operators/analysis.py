"""Accuracy, size, rates and latencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.time import align, div
from tidemark.operators.sketches import ExactTier, ranked


def rank_error(values: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Probes (keys, phi, approx, ...) with ``error``: how far the rank floor(n * phi) lies from the nearest rank of approx,
    over n; 0 inside its ranks. Probes whose value does not occur are dropped. Their other columns stay, so that nothing
    needs to read them again: probes that sketches gave could be others then."""
    rows = ranked(values.select(*keys, "value", F.lit(1).alias("weight")), keys).withColumnRenamed("value", "approx")
    rows = rows.select(*keys, "approx", "first", "last", "n")
    n = F.col("n").cast("double")
    exact = F.floor(n * F.col("phi")).cast("long")
    error = F.when(exact <= F.col("first"), (F.col("first") - exact) / n).when(exact >= F.col("last"), (exact - F.col("last")) / n).otherwise(F.lit(0.0))
    return probes.join(rows, [*keys, "approx"]).select(*probes.columns, error.alias("error"))


def stat_summary(samples: DataFrame, key: str, value: Column) -> DataFrame:
    """Per key: sample_count, median, p95, min and max of the non-null samples; no row without samples."""
    rows = samples.select(F.col(key).alias("wid"), value.cast("long").alias("value")).where("value IS NOT NULL")
    hist = rows.groupBy("wid", "value").agg(F.count("*").alias("weight"))
    found = ExactTier("point").quantiles(ExactTier.frame(hist), [0.5, 0.95], repeats=False)
    out = found.groupBy(F.col("window_start").alias(key)).agg(F.max("count").alias("sample_count"), F.max(F.when(F.col("at") == 0, F.col("approx"))).alias("median"), F.max(F.when(F.col("at") == 1, F.col("approx"))).alias("p95"))
    ends = rows.groupBy(F.col("wid").alias(key)).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return out.join(ends, key)


def rates(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Events per whole second between the first and the last, at least one second."""
    span = F.greatest(F.max(ts) - F.min(ts), F.lit(1)).cast("double")
    return events.groupBy(key).agg((F.count("*") / span).alias("rate"))


def counts(events: DataFrame, names: list[str], seconds: int, start: int, end: int) -> DataFrame:
    """(interval_start, name, count) for every interval from start to before end and every name, zeros included."""
    spark = events.sparkSession
    grid = spark.range(start, end, seconds).withColumnRenamed("id", "interval_start").select("interval_start", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    got = events.groupBy(align(F.col("ts"), seconds).alias("interval_start"), "name").agg(F.count("*").alias("count"))
    return grid.join(got, ["interval_start", "name"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def latencies(events: DataFrame, order: list[str]) -> DataFrame:
    """(worker_id, query_id, duration) from (worker_id, query_id, ts, sent Boolean): each latest send before a receive, with
    the first receive after it. ``order`` breaks ties after ts."""
    w = Window.partitionBy("worker_id", "query_id").orderBy("ts", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = events.withColumn("turn", F.sum(F.col("sent").cast("int")).over(w)).where("turn > 0")
    one = turn.groupBy("worker_id", "query_id", "turn").agg(F.min(F.when(F.col("sent"), F.col("ts"))).alias("a"), F.min(F.when(~F.col("sent"), F.col("ts"))).alias("b"))
    return one.where("b IS NOT NULL").select("worker_id", "query_id", (F.col("b") - F.col("a")).alias("duration"))


def report_intervals(events: DataFrame, seconds: int, key: str = "report") -> DataFrame:
    """``events`` (key, ts, ...) with ``interval``: the data-driven interval of each, numbered from 0 per key.

    The first event opens an interval; the first one at least ``seconds`` after its opening opens the next and belongs to
    it. Events of each key's last interval, which nothing closes, are dropped. Rows stream past in order of key and time;
    what is kept between batches is one key, the opening and number of its interval. Null keys and times are dropped.
    """
    order = Window.partitionBy(key).orderBy("ts")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("__end", F.max(F.col("ts").cast("double")).over(whole))
    rows, columns = rows.sortWithinPartitions(key, "ts"), events.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, number = None, 0.0, 0
        for b in batches:
            if not len(b):
                continue
            names, ts = b.column(key), b.column("ts").cast(pa.float64()).to_numpy(zero_copy_only=False)
            end = b.column("__end").to_numpy(zero_copy_only=False)
            codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(ts)]
            interval, closed = np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
            for a, z in zip(edges[:-1], edges[1:]):
                if names[a].as_py() != current:
                    current, opened, number = names[a].as_py(), ts[a], 0
                while a < z:
                    # differences, as the rule has them; the sum could round otherwise
                    stop = a + int(np.searchsorted(ts[a:z] - opened, seconds, "left"))
                    interval[a:stop], closed[a:stop] = number, end[a] - opened >= seconds
                    if stop < z:
                        number, opened = number + 1, ts[stop]
                    a = stop
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(interval)], names=[*columns, "interval"])
            yield out.filter(pa.array(closed))

    return rows.mapInArrow(cut, StructType([*events.schema.fields, StructField("interval", LongType())]))


def encoded_size(values: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of each key's sorted 32-bit values as deltas: 8 for the length; in blocks of four a control byte and one to
    four bytes a delta; four bytes for each of the rest."""
    w = Window.partitionBy(*keys).orderBy("value")
    rows = values.select(*keys, "value", F.row_number().over(w).alias("place"), (F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0))).alias("delta"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    blocks = div(F.col("n"), 4)
    d = F.col("delta")
    width = F.when(F.col("place") > blocks * 4, 4).when(d < 1 << 8, 1).when(d < 1 << 16, 2).when(d < 1 << 24, 3).otherwise(4)
    return rows.groupBy(*keys).agg((F.sum(width) + F.max(blocks) + 8).cast("long").alias("bytes"))


def partition_and_merge(tier, values: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """Frame with one window from values sketched in random slices and merged again; every value counts."""
    slices = values.select(F.format_string("slice.%d", F.floor(F.rand(seed) * parts)).alias("metric"), F.lit(0).cast("long").alias("ts"), "value")
    return tier.merge_all(tier.open(tier.windowize(slices, 1)))


def error_summary(tier, values: DataFrame, phis: list[float]) -> DataFrame:
    """phi, approx, lower, upper and rank error of one sketch over all values."""
    rows = values.select(F.lit("all").alias("metric"), F.lit(0).cast("long").alias("ts"), "value")
    found = tier.quantiles(tier.open(tier.windowize(rows, 1)), phis).withColumn("metric", F.lit("all"))
    return rank_error(rows.select("metric", "value"), found, ["metric"]).select("phi", "approx", "lower", "upper", "error")
