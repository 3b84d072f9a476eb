"""The two tiers of quantile summaries.

A frame of sketches has a column ``wid`` that tells its windows apart, bounds ``window_start`` and ``window_end``, and the
payload of its tier. Exact: histograms, of which a window may have several rows, each with bounds of its own that the
window spans; so windows merge by a change of ``wid``, and values are counted only where ranks are asked for. A histogram
row covers SPAN values at most, however hot its window. KLL: one row per window with a serialized sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import align, div
from tidemark.model import EPSILON, EXACT_SCHEMA, HIST, KLL_K, KLL_SCHEMA, MAX_VALUE, SPAN


def _in_range(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("value").between(0, MAX_VALUE) & F.col("metric").isNotNull() & F.col("ts").isNotNull())


def _windows(obs: DataFrame, seconds: int, width: int | None) -> DataFrame:
    start = align(F.col("ts"), seconds)
    return _in_range(obs).select("metric", start.alias("window_start"), (start + (width or seconds)).alias("window_end"), "value")


def ranked(rows: DataFrame, keys: list[str], repeats: bool = True) -> DataFrame:
    """Distinct values per key with ``weight``, ``first`` and ``last`` rank from 0, and the key's count ``n``, from rows
    (keys, value, weight); columns window_start and window_end, if there are any, are widened to what the key spans.

    No key meets in one task: values are ranked within spans, and a span begins where the sums of those before it end.
    ``repeats`` says whether many rows share a value, so that counting them before they are dealt out pays.
    """
    bounded = "window_start" in rows.columns
    wide = [F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")] if bounded else []
    rows = rows.withColumn("span", div(F.col("value"), SPAN))
    if not repeats:
        rows = rows.repartition(*keys, "span")
    counted = rows.groupBy(*keys, "span", "value").agg(*wide, F.sum("weight").alias("weight"))
    sums = counted.groupBy(*keys, "span").agg(*wide, F.sum("weight").alias("held"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("held").over(own.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = [F.min("window_start").over(own).alias("s"), F.max("window_end").over(own).alias("e")] if bounded else []
    sums = sums.select(*keys, "span", before.alias("before"), F.sum("held").over(own).alias("n"), *spread)
    upto = Window.partitionBy(*keys, "span").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counted.withColumn("upto", F.sum("weight").over(upto)).join(sums, [*keys, "span"])
    last = F.col("before") + F.col("upto") - 1
    # both sides name all columns of the counted rows, so that they share one exchange
    bounds = [F.least("window_start", "s").alias("window_start"), F.greatest("window_end", "e").alias("window_end")] if bounded else []
    return out.select(*keys, "value", "weight", *bounds, (last - F.col("weight") + 1).alias("first"), last.alias("last"), "n")


class ExactTier:
    """Every value kept, as a histogram. ``bounds``: "rank" (the weighted rule) or "point" (all equal to the quantile)."""

    name = "exact"
    schema = EXACT_SCHEMA

    def __init__(self, bounds: str = "rank") -> None:
        if bounds not in ("rank", "point"):
            raise ValueError(bounds)
        self.bounds = bounds

    def windowize(self, obs: DataFrame, seconds: int, width: int | None = None, tasks: int | None = None) -> DataFrame:
        """Stored windows of observations; values outside 32 unsigned bits are dropped. One row per window and span.

        ``tasks`` is for many small windows, in which few values repeat: these are dealt out once, to so many tasks.
        """
        rows, span = _windows(obs, seconds, width), div(F.col("value"), SPAN)
        if tasks:
            rows = rows.withColumn("span", span).repartition(tasks, "metric", "window_start", "span")
        one = rows.groupBy(*rows.columns).agg(F.count("*").alias("weight"))
        return self._pack(one if tasks else one.withColumn("span", span))

    def _pack(self, rows: DataFrame) -> DataFrame:
        hist = F.array_sort(F.collect_list(F.struct("value", "weight"))).cast(HIST)
        packed = rows.groupBy("metric", "window_start", "span").agg(
            F.max("window_end").alias("window_end"), F.sum("weight").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), hist.alias("hist")
        )
        return packed.drop("span")

    def merge_stored(self, windows: DataFrame) -> DataFrame:
        """One row per metric, window start and span: histograms added up, the later end kept."""
        rows = windows.select("metric", "window_start", "window_end", F.inline("hist"))
        one = rows.groupBy("metric", "window_start", "value").agg(F.max("window_end").alias("window_end"), F.sum("weight").alias("weight"))
        return self._pack(one.withColumn("span", div(F.col("value"), SPAN)))

    def totals(self, windows: DataFrame) -> DataFrame:
        """One row per stored window: metric, bounds, count, least and greatest value, number of distinct values kept."""
        return windows.groupBy("metric", "window_start").agg(
            F.max("window_end").alias("window_end"), F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum(F.size("hist")).alias("stored")
        )

    def open(self, windows: DataFrame) -> DataFrame:
        """Frame of a metric's stored windows."""
        return windows.select(F.col("window_start").alias("wid"), "window_start", "window_end", "hist")

    @staticmethod
    def frame(rows: DataFrame) -> DataFrame:
        """Frame of (wid, value, weight) rows; the bounds are the window's name."""
        hist = F.array(F.struct(F.col("value").cast("long").alias("value"), F.col("weight").cast("long").alias("weight")))
        return rows.select("wid", F.col("wid").alias("window_start"), F.col("wid").alias("window_end"), hist.alias("hist"))

    def spans(self, frame: DataFrame, *keys: str) -> DataFrame:
        """(keys, window_start, window_end) of every window; payloads are not read."""
        return frame.groupBy(*keys).agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"))

    def settle(self, frame: DataFrame) -> DataFrame:
        """Every row with the bounds of its whole window."""
        return frame.drop("window_start", "window_end").join(self.spans(frame, "wid"), "wid").select("wid", "window_start", "window_end", "hist")

    def merge(self, frame: DataFrame, key: Column) -> DataFrame:
        """Windows with equal keys become one that spans them."""
        return frame.select(key.cast("long").alias("wid"), "window_start", "window_end", "hist")

    def merge_all(self, frame: DataFrame) -> DataFrame:
        """All windows as one."""
        return self.merge(frame, F.lit(0))

    def summary(self, frame: DataFrame) -> DataFrame:
        """Count, least and greatest value of every window."""
        rows = frame.select("wid", "window_start", "window_end", F.inline("hist"))
        return rows.groupBy("wid").agg(
            F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.sum("weight").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax")
        ).drop("wid")

    def readable(self, frame: DataFrame) -> DataFrame:
        """Weighted values (window_start, window_end, value, weight) of every window."""
        rows = self.settle(frame).select("window_start", "window_end", F.inline("hist"))
        return rows.groupBy("window_start", "window_end", "value").agg(F.sum("weight").alias("weight"))

    def quantiles(self, frame: DataFrame, phis: list[float], repeats: bool = True) -> DataFrame:
        """Rows (window_start, window_end, at, phi, count, approx, lower, upper), ``at`` the place of phi in the list.

        The quantile has rank floor(n * phi) from 0. Values are ranked span by span, then one aggregate per window picks
        the values of all phis, on the map side first.
        """
        rows = ranked(frame.select("wid", "window_start", "window_end", F.inline("hist")), ["wid"], repeats)
        err = F.ceil(F.col("n").cast("float") * F.lit(EPSILON).cast("float")).cast("long")
        picks = []
        for k, phi in enumerate(phis):
            target = F.least(F.floor(F.col("n").cast("double") * F.lit(float(phi))).cast("long"), F.col("n") - 1)
            below = F.max(F.when(F.col("last") + err < target, F.col("value")))
            above = F.min(F.when((F.col("first") > target) & (F.col("first") >= err) & (F.col("first") - err < target), F.col("value")))
            at = F.max(F.when((F.col("first") <= target) & (F.col("last") >= target), F.col("value")))
            picks += [at.alias(f"at{k}"), below.alias(f"below{k}"), above.alias(f"above{k}")]
        found = rows.groupBy("wid").agg(
            F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.max("n").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"), *picks
        )

        def bounds(k: int) -> list[Column]:
            if self.bounds == "point":
                return [F.col(f"at{k}").alias("lower"), F.col(f"at{k}").alias("upper")]
            return [F.coalesce(f"below{k}", "least").alias("lower"), F.coalesce(f"above{k}", "most").alias("upper")]

        rows = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(float(p)).alias("phi"), "count", F.col(f"at{k}").alias("approx"), *bounds(k)) for k, p in enumerate(phis)])
        return found.select("window_start", "window_end", F.inline(rows))


class KllTier:
    """Spark's KLL sketches. Their results vary between runs within the rank error of ``k``."""

    name = "kll"
    schema = KLL_SCHEMA

    def __init__(self, k: int = KLL_K) -> None:
        self.k = k

    def _build(self) -> Column:
        return F.expr(f"kll_sketch_agg_bigint(value, {self.k})")

    def _merge(self) -> Column:
        return F.expr(f"kll_merge_agg_bigint(kll, {self.k})")

    def windowize(self, obs: DataFrame, seconds: int, width: int | None = None) -> DataFrame:
        """Stored windows of observations."""
        return _windows(obs, seconds, width).groupBy("metric", "window_start").agg(
            F.max("window_end").alias("window_end"), F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), self._build().alias("kll")
        )

    def _added(self, rows: DataFrame, *keys: Column | str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.min("window_start").alias("first_start"), F.max("window_end").alias("window_end"), F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), self._merge().alias("kll")
        )

    def merge_stored(self, windows: DataFrame) -> DataFrame:
        """One row per metric and window start."""
        return self._added(windows, "metric", "window_start").drop("first_start")

    def totals(self, windows: DataFrame) -> DataFrame:
        """One row per stored window, without its sketch."""
        return windows.groupBy("metric", "window_start").agg(F.max("window_end").alias("window_end"), F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))

    def open(self, windows: DataFrame) -> DataFrame:
        """Frame of a metric's stored windows."""
        return self.merge(windows, F.col("window_start"))

    def spans(self, frame: DataFrame, *keys: str) -> DataFrame:
        """(keys, window_start, window_end) of every window."""
        return frame.select(*keys, "window_start", "window_end")

    def settle(self, frame: DataFrame) -> DataFrame:
        """Rows are windows already."""
        return frame

    def merge(self, frame: DataFrame, key: Column) -> DataFrame:
        """Windows with equal keys become one that spans them."""
        return self._added(frame, key.cast("long").alias("wid")).where("n > 0").withColumnRenamed("first_start", "window_start")

    def merge_all(self, frame: DataFrame) -> DataFrame:
        """All windows as one."""
        return self.merge(frame, F.lit(0))

    def summary(self, frame: DataFrame) -> DataFrame:
        """Count, least and greatest value of every window."""
        return frame.select("window_start", "window_end", "n", "vmin", "vmax")

    def readable(self, frame: DataFrame, steps: int = 200) -> DataFrame:
        """Weighted values (window_start, window_end, value, weight) of every window: its quantiles at ``steps`` even ranks
        (at all ranks, if it has fewer values), each for its share of the count. The weights add up to the count."""
        n = F.col("n")
        at = F.expr(f"kll_sketch_get_quantile_bigint(kll, array({', '.join(f'{(k + 0.5) / steps!r}D' for k in range(steps))}))")
        rows = frame.where("n > 0").select("window_start", "window_end", n, F.posexplode(at).alias("k", "value"))
        upto = F.floor((F.col("k") + 1) * n / F.lit(steps)).cast("long") - F.floor(F.col("k") * n / F.lit(steps)).cast("long")
        rows = rows.select("window_start", "window_end", "value", upto.alias("weight")).where("weight > 0")
        return rows.groupBy("window_start", "window_end", "value").agg(F.sum("weight").alias("weight"))

    def quantiles(self, frame: DataFrame, phis: list[float], repeats: bool = True) -> DataFrame:
        """As in the exact tier; bounds are the quantiles the rank error away, within the exact extremes."""

        def at(rank: float) -> Column:
            if rank <= 0:
                return F.col("vmin")
            return F.col("vmax") if rank >= 1 else F.expr(f"kll_sketch_get_quantile_bigint(kll, {rank!r}D)")

        rows = F.array(*[
            F.struct(F.lit(k).alias("at"), F.lit(float(p)).alias("phi"), F.col("n").alias("count"), at(p + 1e-6).alias("approx"), at(p - EPSILON).alias("lower"), at(p + EPSILON).alias("upper"))
            for k, p in enumerate(phis)
        ])
        return frame.where("n > 0").select("window_start", "window_end", F.inline(rows))

    def size(self, frame: DataFrame) -> DataFrame:
        """Retained values and bytes of every sketch."""
        kept = F.regexp_extract(F.expr("kll_sketch_to_string_bigint(kll)"), r"Retained Items\s*:\s*([0-9,]+)", 1)
        return frame.select("window_start", "window_end", "n", F.regexp_replace(kept, ",", "").cast("long").alias("retained"), F.length("kll").cast("long").alias("bytes"))
