"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators.downsample import downsample
from tidemark.operators.sketches import ExactTier, KllTier
from tidemark.plans.planner import Engine
from tidemark.sources.observations import from_events
from tidemark.sources.store import MemoryStore

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
#: Seconds after which each query still gets its warm-up and one timed run, but no more.
SECONDS = float(os.environ.get("BENCH_SECONDS", "420"))
NAMES = (
    "quantile_median", "group_hours", "coalesce_all", "combine_two", "combine_five", "windowize_10s", "downsample_tiers", "statsd_parse",
    "search_infix", "circuit_widening", "rank_error", "latency_match", "encoded_size", "weighted_quantile", "kll_merge",
)
SHAPES = {
    "shape_quantile_1": ('quantile(fetch("one"), 0.5)', 1),
    "shape_quantile_1000": ('quantile(fetch("many"), 0.5)', 1000),
    "shape_coalesce_1000": ('quantile(coalesce(fetch("many")), 0.5)', 1000),
    "shape_combine_2x500": ('quantile(combine(fetch("left"), fetch("right")), 0.5)', 1000),
}


def shapes(spark: SparkSession, tier):
    """A store with one window, 1000 windows, and twice 500 windows, written so that only the query is timed."""
    def series(name: str, windows: int):
        return spark.range(windows * 2048).select(F.lit(name).alias("metric"), (F.col("id") / 2048).cast("long").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("value"))

    obs = series("one", 1).unionByName(series("many", 1000)).unionByName(series("left", 500)).unionByName(series("right", 500))
    return Engine(MemoryStore(tier, tier.windowize(obs, 1).persist()))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda f=queries.QUERIES[n]: f(spark, SF)) for n in NAMES}
    for tier in (ExactTier(), KllTier()):
        e = shapes(spark, tier)
        e.store.windows().count()
        runs |= {f"{n}_{tier.name}": (lambda q=q, e=e: e.query(q)) for n, (q, _) in SHAPES.items()}
    runs |= {
        "windowize_10s_kll": lambda: KllTier().windowize(from_events(spark, SF), 10),
        "downsample_tiers_kll": lambda: downsample(KllTier(), KllTier().windowize(from_events(spark, SF), 10), 1706659200),
    }
    took, started = {}, time.perf_counter()
    for name, make in runs.items():
        times = []
        # one warm-up, then the timed runs
        while len(times) <= RUNS and (len(times) < 2 or time.perf_counter() - started < SECONDS):
            begun = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
