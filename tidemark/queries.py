"""Registered queries of the quantile engine; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.names import valid_name
from tidemark.functions.time import align, days, disjoint, div, duration, hours, overlaps
from tidemark.operators import analysis
from tidemark.operators.downsample import downsample, plan
from tidemark.operators.sketches import ExactTier, KllTier
from tidemark.operators.windows import islands
from tidemark.plans.planner import Engine
from tidemark.sources.load import report
from tidemark.sources.observations import from_events, from_lineitem, insert_specs, numbers, parse_lines, query_lines, synthetic, tasks
from tidemark.sources.store import DiskStore, MemoryStore
from tidemark.streaming.ingest import circuit, closed_windows, flush_into_store, flushed, into_store

Query = Callable[[SparkSession, str], DataFrame]
HOUR = 3600
CLICK, VIEW = "events.click", "events.view"
PHIS = [0.1, 0.5, 0.9]
FIVE = ("click", "error", "purchase", "signup", "view")


def engine(spark: SparkSession, sf_dir: str, tier=None, width: int | None = None, source=from_events) -> Engine:
    """Engine over hourly windows of the events."""
    tier = tier or ExactTier()
    return Engine(MemoryStore(tier, tier.windowize(source(spark, sf_dir), HOUR, width)))


def _asked(text: str, **options) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, **options).query(text)


def _sketch(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return e.tier.summary(e.plan(text).df)

    return run


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statsd lines made of the events, good and bad ones by turns."""
    o = from_events(spark, sf_dir)
    k = F.col("event_id") % 8
    value = F.col("value").cast("string")
    line = (
        F.when(k == 0, F.concat("metric", F.lit(":"), value, F.lit("|ms|@0.1")))
        .when(k == 1, F.concat("metric", F.lit(":"), value, F.lit("|c")))
        .when(k == 2, F.concat(F.lit("."), "metric", F.lit(":"), value, F.lit("|ms")))
        .when(k == 3, F.concat("metric", F.lit(":4294967296|ms")))
        .when(k == 4, F.concat("metric", F.lit(":"), value, F.lit("|ms|@1")))
        .otherwise(F.concat("metric", F.lit(":"), value, F.lit("|ms")))
    )
    return o.select("event_id", line.alias("value"))


def statsd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_lines(spark, sf_dir))


def metric_name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "1", ".", "a&", "us-west.", "env_")]), (F.col("event_id") % 6 + 1).cast("int")), "event_type")
    return rows.select("event_id", name.alias("name"), valid_name(name).alias("valid"))


def windowize_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = ExactTier()
    return tier.totals(tier.windowize(from_events(spark, sf_dir), 10)).drop("stored")


def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir)
    s, e = align(F.col("ts"), 30), align(F.col("ts"), 30) + 45
    o_s, o_e = align(F.col("ts"), 60), align(F.col("ts"), 60) + 30
    return o.select(
        "event_id", hours(F.col("ts")).alias("hours"), days(F.col("ts")).alias("days"), s.alias("window_start"), duration(s, e).alias("duration"),
        overlaps(s, e, o_s, o_e).alias("overlaps"), disjoint(s, e, o_s, o_e).alias("disjoint"),
    )


def _halves(spark: SparkSession, sf_dir: str, tier) -> list[DataFrame]:
    o = from_events(spark, sf_dir)
    return [tier.windowize(o.where(F.col("event_id") % 2 == k), HOUR, HOUR * (k + 1)) for k in (0, 1)]


def insert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts into a store on disk, of which the second's windows are twice as long."""
    tier = ExactTier()
    store = DiskStore(spark, tier, _folder(spark, "store"))
    for part in _halves(spark, sf_dir, tier):
        store.insert(part)
    return tier.totals(store.windows()).drop("stored")


_LOCAL: list[str] = []


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see; a local session without one gets a temporary folder that ends with it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is None and not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"{base or _LOCAL[0]}/tidemark/{label}-{uuid.uuid4().hex}"


def _observed(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "user_id", F.concat(F.lit("events."), "event_type").alias("metric"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _observed(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))  # a pattern, since a stream takes no single file


def stream_windowize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a store, read back."""
    tier = ExactTier()
    store = DiskStore(spark, tier, _folder(spark, "stream"))
    into_store(_stream(spark, sf_dir), store, 10, _folder(spark, "progress")).awaitTermination()
    return tier.totals(store.windows()).drop("stored")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches of which the second is late by all the first's time: its windows merge with those stored."""
    tier, source = ExactTier(), _folder(spark, "late")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).write.parquet(f"{source}/{k}")
    store = DiskStore(spark, tier, _folder(spark, "stream"))
    for k in (0, 1):
        rows = _observed(spark.readStream.schema(e.schema).parquet(f"{source}/{k}"))
        into_store(rows, store, 10, _folder(spark, "progress")).awaitTermination()
    return tier.totals(store.windows()).drop("stored")


def stream_append_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows that the watermark closes, each inserted once; those still open at the stream's end are not there."""
    tier = ExactTier()
    store = DiskStore(spark, tier, _folder(spark, "stream"))
    flush_into_store(_stream(spark, sf_dir), store, HOUR, _folder(spark, "progress")).awaitTermination()
    return tier.totals(store.windows()).drop("stored")


def stream_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples and closes of two daemons as a stream; every third close succeeds."""
    source, out = _folder(spark, "commands"), _folder(spark, "flushed")
    c = closes(spark, sf_dir)
    none = F.lit(None)
    ends = c.select("daemon", "i", none.cast("string").alias("metric"), none.cast("long").alias("n"), "window_start", "window_end", "ok")
    samples = _by_daemon(spark, sf_dir).join(c, ["daemon", "window_start"])
    samples = samples.select("daemon", "i", "metric", F.lit(1).cast("long").alias("n"), none.cast("long").alias("window_start"), none.cast("long").alias("window_end"), none.cast("boolean").alias("ok"))
    commands = ends.unionByName(samples)
    commands.write.parquet(source)
    stream = circuit(spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1_000_000).parquet(source))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _folder(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert, a downsampling pass, the same insert again (known, so skipped), and another."""
    tier = ExactTier()
    store = DiskStore(spark, tier, _folder(spark, "store"))
    o = from_events(spark, sf_dir)
    parts = [tier.windowize(o.where(F.col("event_id") % 2 == k), 10) for k in (0, 1)]
    store.insert(parts[0], writer="daemon", number=0)
    store.downsample(1706659200)
    store.insert(parts[0], writer="daemon", number=0)
    store.insert(parts[1], writer="daemon", number=1)
    return tier.totals(store.windows()).drop("vmin", "vmax", "stored")


def number_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as a file of numbers, each followed by a line that is none, read back."""
    path = _folder(spark, "numbers")
    v = F.col("value").cast("string")
    from_events(spark, sf_dir).select(F.explode(F.array(v, F.concat(F.lit("-x"), v))).alias("value")).write.text(path)
    return numbers(spark, path)


def insert_spec_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and names as lines, with malformed ones between, read back."""
    path = _folder(spark, "specs")
    n = from_events(spark, sf_dir).groupBy("metric").agg(F.count("*").cast("string").alias("n"))
    n.select(F.explode(F.array(F.concat_ws(" ", "n", "metric"), F.concat_ws(" ", "metric", "n"), F.col("n"))).alias("value")).write.text(path)
    return insert_specs(spark, path)


def synthetic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated windows: one for every event of a type, five values each."""
    specs = from_events(spark, sf_dir).groupBy(F.col("metric").alias("name")).agg(F.count("*").alias("count"))
    n = tasks(specs, 5)
    made = ExactTier().windowize(synthetic(spark, specs, 1_000_000, 30, 5, most=n), 10, tasks=n)
    return made.select("metric", "window_start", "window_end", "n", ((F.col("vmin") >= 0) & (F.col("vmax") < 10_000)).alias("bounded"))


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from a file, one a line, run one after the other."""
    path = _folder(spark, "queries")
    spark.createDataFrame([(f'quantile(fetch("{m}"), 0.5)',) for m in (CLICK, VIEW)], "value string").coalesce(1).write.text(path)
    e = engine(spark, sf_dir)
    first, second = (e.query(q) for q in query_lines(spark, path))
    return first.unionByName(second)


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of report intervals of 5000 seconds by event type."""
    e = from_events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("ts").cast("double").alias("ts"))
    return report(e, 5000)


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each window's values, and whether they decode to the same."""
    o = from_events(spark, sf_dir).select("metric", align(F.col("ts"), HOUR).alias("window_start"), "value")
    v = o.groupBy("metric", "window_start").agg(F.sort_array(F.collect_list("value")).alias("v")).withColumn("data", codec.encoded(F.col("v")))
    return v.select("metric", "window_start", F.length("data").cast("long").alias("bytes"), (codec.decoded(F.col("data")) == F.col("v")).alias("same"))


def exact_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.tier.readable(e.plan(f'group("days", fetch("{CLICK}"))').df)


def _tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactTier().windowize(from_events(spark, sf_dir), 10)


def _downsampled(now: int) -> Query:
    return lambda spark, sf_dir: ExactTier().totals(downsample(ExactTier(), _tens(spark, sf_dir), now)).drop("vmin", "vmax", "stored")


def downsample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(ExactTier().totals(_tens(spark, sf_dir)), 1706659200).select("metric", "window_start", "window_end", "action", "new_start", "new_end")


def downsample_then_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = ExactTier()
    return Engine(MemoryStore(tier, downsample(tier, _tens(spark, sf_dir), 1706659200))).query(f'quantile(fetch("{CLICK}"), 0.5)')


def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir)
    w = o.select(align(F.col("ts"), 600).alias("window_start"), (align(F.col("ts"), 600) + 600 + F.col("user_id") % 5 * 300).alias("window_end"))
    return islands(w.distinct())


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window closes of two daemons by the hours that they saw events in; every third one succeeds."""
    o = from_events(spark, sf_dir).withColumn("daemon", F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")))
    w = o.select("daemon", align(F.col("ts"), HOUR).alias("window_start")).distinct()
    i = F.row_number().over(Window.partitionBy("daemon").orderBy("window_start"))
    return w.select("daemon", i.cast("long").alias("i"), "window_start", (F.col("window_start") + HOUR).alias("window_end"), (i % 3 == 0).alias("ok"))


def _by_daemon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir).withColumn("daemon", F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string"))).withColumn("window_start", align(F.col("ts"), HOUR))


def circuit_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = closes(spark, sf_dir)
    seen = _by_daemon(spark, sf_dir).join(c, ["daemon", "window_start"]).groupBy("daemon", "metric", "i").agg(F.count("*").alias("n"))
    return flushed(seen, c)


def window_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("daemon"), F.col("ts").alias("now")).distinct()
    return closed_windows(o, 30)


def rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the values a twentieth of the ranks below the median."""
    o = from_events(spark, sf_dir).select("metric", "value")
    tier = ExactTier("point")
    hist = o.groupBy(F.col("metric").alias("wid"), "value").agg(F.count("*").alias("weight"))
    probes = tier.quantiles(tier.frame(hist), [0.45], repeats=False).select(F.col("window_start").alias("metric"), F.lit(0.5).alias("phi"), "approx")
    return analysis.rank_error(o, probes, ["metric"])


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.error_summary(ExactTier(), from_events(spark, sf_dir), [k / 10 for k in range(1, 10)])


def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.stat_summary(from_events(spark, sf_dir), "metric", F.col("value"))


def rate_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.rates(from_events(spark, sf_dir), "metric")


def count_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by hour; the name ``none`` has no events, so its zeros show."""
    o = from_events(spark, sf_dir).withColumn("name", F.col("event_type"))
    return analysis.counts(o, [*FIVE, "none"], HOUR, 1704067200, 1706659200)


def latency_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase"))
    e = o.select(F.col("user_id").alias("worker_id"), (F.col("user_id") % 4).alias("query_id"), "ts", "event_id", (F.col("event_type") == "click").alias("sent"))
    return analysis.stat_summary(analysis.latencies(e, ["event_id"]), "query_id", F.col("duration"))


def report_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir).select("event_id", F.col("event_type").alias("report"), F.col("ts").cast("double").alias("ts"))
    return analysis.report_intervals(o, 5000).select("report", "interval", "ts").groupBy("report", "interval").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = from_events(spark, sf_dir).select("metric", align(F.col("ts"), HOUR).alias("window_start"), "value")
    return analysis.encoded_size(o, ["metric", "window_start"])


def exact_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = ExactTier()
    return tier.totals(tier.windowize(from_events(spark, sf_dir), HOUR)).select("metric", "window_start", "stored")


def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of weighted values: the quantity of a line weighs its price."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = rows.select(F.col("l_returnflag").alias("wid"), F.round(F.col("l_extendedprice")).cast("long").alias("value"), F.col("l_quantity").cast("long").alias("weight"))
    found = ExactTier().quantiles(ExactTier.frame(w), PHIS)
    return found.select(F.col("window_start").alias("flag"), "phi", "count", "approx", "lower", "upper")


def partition_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = ExactTier()
    frame = analysis.partition_and_merge(tier, from_events(spark, sf_dir), 10)
    return tier.quantiles(frame, PHIS).select("phi", "count", "approx", "lower", "upper")


def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).text(f'quantile(group("days", fetch("{CLICK}")), 0.5, 0.9)')


def _kll_error(found: DataFrame, values: DataFrame) -> DataFrame:
    errors = analysis.rank_error(values, found, ["metric"])
    return errors.select("metric", "phi", "count", (F.col("error") <= 0.02).alias("within"))


def kll_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketches of all values of a metric stay within the rank error."""
    tier, values = KllTier(), from_lineitem(spark, sf_dir)
    w = tier.windowize(values.withColumn("ts", F.lit(0).cast("long")), HOUR)
    frame = w.withColumn("wid", F.col("metric")).withColumns({"window_start": F.col("metric"), "window_end": F.col("metric")})
    found = tier.quantiles(frame, PHIS).withColumnRenamed("window_start", "metric")
    return _kll_error(found, values.select("metric", "value"))


def kll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by merging the sketches of days."""
    tier, values = KllTier(), from_lineitem(spark, sf_dir)
    store = MemoryStore(tier, tier.windowize(values, 86_400))
    parts = [Engine(store).plan(f'quantile(coalesce(fetch("ship.{flag}")), 0.1, 0.5, 0.9)').df.withColumn("metric", F.lit(f"ship.{flag}")) for flag in "ANR"]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _kll_error(found, values.select("metric", "value"))


def kll_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = KllTier()
    frame = engine(spark, sf_dir, tier).plan(f'fetch("{CLICK}")').df
    return tier.size(frame).select("window_start", "n", (F.col("retained") <= F.col("n")).alias("bounded"))


def _kll_windows(text: str, unit: int) -> Query:
    """Whether quantiles that a query finds in sketches stay within the rank error of all values of the same unit of time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, sf_dir, KllTier()).query(text)
        o = from_events(spark, sf_dir)
        values = o.where(F.col("metric").isin(*[m for m in (CLICK, VIEW) if f'"{m}"' in text])).select(div(F.col("ts"), unit).alias("unit"), "value")
        keyed = found.withColumn("unit", div(F.col("window_start"), unit))
        errors = analysis.rank_error(values, keyed, ["unit"])
        return errors.select("window_start", "window_end", "phi", "count", (F.col("error") <= 0.02).alias("within"))

    return run


def kll_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = KllTier()
    return tier.totals(downsample(tier, tier.windowize(from_events(spark, sf_dir), 10), 1706659200)).drop("vmin", "vmax")


def kll_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the weights of a sketch's values add up to its count, and its values lie within its extremes."""
    e = engine(spark, sf_dir, KllTier())
    found = e.tier.readable(e.plan(f'group("days", fetch("{CLICK}"))').df)
    return found.groupBy("window_start", "window_end").agg(F.sum("weight").alias("n"), (F.max("value") > F.min("value")).alias("spread"))


def _combined(*names: str) -> str:
    return f"combine({', '.join(f'fetch(\"events.{n}\")' for n in names)})"


QUERIES: dict[str, Query] = {
    "fetch_all": _sketch(f'fetch("{CLICK}")'),
    "fetch_from": _sketch(f'fetch("{CLICK}", 1705000000)'),
    "fetch_range": _sketch(f'fetch("{CLICK}", 1705000000, 1705500000)'),
    "fetch_missing": _sketch('fetch("events.none")'),
    "search_all": _asked('search("*")'),
    "search_prefix": _asked('search("events.c*")'),
    "search_infix": _asked('search("*.*r*")'),
    "search_exact": _asked('search("events.view")'),
    "search_underscore_literal": _asked('search("events_*")'),
    "quantile_median": _asked(f'quantile(fetch("{CLICK}"), 0.5)'),
    "quantile_multi": _asked(f'quantile(fetch("{CLICK}"), 0.1, 0.5, 0.9)'),
    "quantile_bounds_rank": _asked('quantile(coalesce(fetch("ship.A")), 0.1, 0.5, 0.9)', source=from_lineitem),
    "quantile_bounds_point": _asked(f'quantile(fetch("{CLICK}"), 0.25)', tier=ExactTier("point")),
    "quantile_dup_phi": _asked(f'quantile(fetch("{CLICK}"), 0.5, 0.5)'),
    "group_seconds": _asked(f'quantile(group("seconds", fetch("{CLICK}")), 0.5)'),
    "group_hours": _asked(f'quantile(group("hours", fetch("{CLICK}")), 0.5)'),
    "group_days": _asked(f'quantile(group("days", fetch("{CLICK}")), 0.29)'),
    "coalesce_all": _asked(f'quantile(coalesce(fetch("{CLICK}")), 0.1, 0.5, 0.9)'),
    "coalesce_idempotent": _asked(f'quantile(coalesce(coalesce(fetch("{CLICK}"))), 0.5)'),
    "coalesce_empty": _asked('quantile(coalesce(fetch("events.none")), 0.5)'),
    "combine_two": _asked(f"quantile({_combined('click', 'view')}, 0.5)"),
    "combine_self_doubles": _asked(f"quantile({_combined('click', 'click')}, 0.5)"),
    "combine_overlap": _asked(f"quantile({_combined('click', 'signup')}, 0.5)", width=5400),
    "combine_five": _asked(f"quantile({_combined(*FIVE)}, 0.5)"),
    "combine_none": _asked("quantile(combine(), 0.5)"),
    "overlap_islands": overlap_islands,
    "pipeline_combine_group_quantile": _asked(f'quantile(group("days", {_combined("click", "view")}), 0.1, 0.9)'),
    "pipeline_group_coalesce": _asked(f'quantile(coalesce(group("hours", fetch("{VIEW}"))), 0.5)'),
    "windowize_10s": windowize_10s,
    "statsd_parse": statsd_parse,
    "metric_name_valid": metric_name_valid,
    "time_functions": time_functions,
    "window_tracker": window_tracker,
    "circuit_widening": circuit_widening,
    "insert_merge": insert_merge,
    "stream_windowize": stream_windowize,
    "downsample_plan": downsample_plan,
    "downsample_tiers": _downsampled(1706659200),
    "downsample_retention": _downsampled(1735689600),
    "downsample_then_quantile": downsample_then_quantile,
    "weighted_quantile": weighted_quantile,
    "partition_and_merge": partition_and_merge,
    "rank_error": rank_error,
    "error_summary": error_summary,
    "stat_summary": stat_summary,
    "rate_tracker": rate_tracker,
    "count_tracker": count_tracker,
    "latency_match": latency_match,
    "report_intervals": report_intervals,
    "encoded_size": encoded_size,
    "exact_size": exact_size,
    "format_lines": format_lines,
    "kll_quantile": kll_quantile,
    "kll_merge": kll_merge,
    "kll_size": kll_size,
    "kll_group": _kll_windows(f'quantile(group("days", fetch("{CLICK}")), 0.1, 0.5, 0.9)', 86_400),
    "kll_combine": _kll_windows(f'quantile(group("days", {_combined("click", "view")}), 0.1, 0.9)', 86_400),
    "kll_downsample": kll_downsample,
    "kll_readable": kll_readable,
    "exact_readable": exact_readable,
    "fetch_u64_bounds": _asked(f'quantile(fetch("{CLICK}", 0, 18446744073709551615), 0.5)'),
    "fetch_beyond": _asked(f'quantile(fetch("{CLICK}", 9223372036854775808), 0.5)'),
    "stream_late": stream_late,
    "stream_append_exact": stream_append_exact,
    "stream_circuit": stream_circuit,
    "store_replay": store_replay,
    "number_file": number_file,
    "insert_spec_file": insert_spec_file,
    "synthetic_windows": synthetic_windows,
    "query_file": query_file,
    "load_report": load_report,
    "codec_roundtrip": codec_roundtrip,
}
