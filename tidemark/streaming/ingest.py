"""Ingest: windows of a stream, and the widening of windows while the sink is down."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.time import align
from tidemark.model import MAX_VALUE
from tidemark.operators.sketches import KllTier


def into_store(observations: DataFrame, store, seconds: int, checkpoint: str, **trigger) -> StreamingQuery:
    """Stream (metric, ts, value) into a disk store. Late samples merge with their stored window, however late.

    Each micro-batch is aggregated on its own and inserted under its number, so a batch that runs again is known, also
    after its rows have been folded or downsampled; no state is kept between batches.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.insert(store.tier.windowize(batch, seconds), writer=checkpoint, number=number)

    return observations.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def windows(observations: DataFrame, seconds: int, watermark: str = "30 seconds", tier=None) -> DataFrame:
    """Streaming stored windows of the tier (KLL by default); a window is emitted when the watermark passes its end, and
    later samples of it are dropped. ``ts`` is in Unix seconds.

    Exact windows come as one row per distinct value, so that no state holds a whole hot window; ``merge_stored`` packs them.
    """
    tier = tier or KllTier()
    rows = observations.where(F.col("value").between(0, MAX_VALUE)).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", watermark)
    own = F.window("at", f"{seconds} seconds").alias("w")
    ends = [F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end")]
    if tier.name == "exact":
        found = rows.groupBy("metric", own, "value").agg(F.count("*").alias("n"))
        hist = F.array(F.struct("value", F.col("n").alias("weight"))).alias("hist")
        return found.select("metric", *ends, "n", F.col("value").alias("vmin"), F.col("value").alias("vmax"), hist)
    found = rows.groupBy("metric", own).agg(F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.expr(f"kll_sketch_agg_bigint(value, {tier.k})").alias("kll"))
    return found.select("metric", *ends, "n", "vmin", "vmax", "kll")


def flush_into_store(observations: DataFrame, store, seconds: int, checkpoint: str, watermark: str = "30 seconds", **trigger) -> StreamingQuery:
    """Like ``into_store``, but windows stay in the stream's state until they close, and each is inserted once, whole."""

    def put(batch: DataFrame, number: int) -> None:
        store.insert(store.tier.merge_stored(batch), writer=checkpoint, number=number)

    closed = windows(observations, seconds, watermark, store.tier)
    return closed.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


_CIRCUIT = "daemon string, metric string, window_start long, window_end long, n long"


def circuit(commands: DataFrame) -> DataFrame:
    """Streaming counts (daemon, metric, window_start, window_end, n) that daemons flush, from commands (daemon, i, metric, n,
    window_start, window_end, ok) in order of ``i`` per daemon: samples have a metric and n, closes a window and ``ok``.

    While ``ok`` is false nothing flushes and samples add up; the next flush spans everything since the last. State is kept
    per daemon: where the next flush begins, and the counts by metric. Commands of a daemon reach it in order of the
    micro-batches; within one they are sorted. A sample ranks before a close of the same ``i``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, names, sums = state.get if state.exists else (None, [], [])
        held = dict(zip(names, sums))
        rows = pd.concat(list(parts))
        rows["closes"] = rows["metric"].isna()
        out = []
        for r in rows.sort_values(["i", "closes"], kind="stable").itertuples():
            if not r.closes:
                held[r.metric] = held.get(r.metric, 0) + int(r.n)
                continue
            begun = int(r.window_start) if begun is None else begun
            if r.ok:
                out += [(key[0], m, begun, int(r.window_end), c) for m, c in held.items()]
                begun = int(r.window_end)
                held = {}
        state.update((begun, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["daemon", "metric", "window_start", "window_end", "n"])

    kept = "begun long, names array<string>, sums array<long>"
    return commands.groupBy("daemon").applyInPandasWithState(step, _CIRCUIT, kept, "append", GroupStateTimeout.NoTimeout)


def closed_windows(ticks: DataFrame, seconds: int, key: str = "daemon") -> DataFrame:
    """(key, now, window_start, window_end) for each tick that closes a window: the one of the tick before, if this tick
    lies in another."""
    before = F.lag("now").over(Window.partitionBy(key).orderBy("now"))
    rows = ticks.withColumn("window_start", align(before, seconds)).where(F.col("window_start") < align(F.col("now"), seconds))
    return rows.select(key, "now", "window_start", (F.col("window_start") + seconds).alias("window_end"))


def flushes(closes: DataFrame, key: str = "daemon") -> DataFrame:
    """From closes (key, i, window_start, window_end, ok) in order of i: (key, g, window_start, window_end) of each flush.

    While ``ok`` is false nothing flushes; the next flush spans everything since the last. After the first, flushes are
    contiguous. ``g`` numbers them, by closes with ok before.
    """
    order = Window.partitionBy(key).orderBy("i")
    g = F.coalesce(F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    spans = closes.withColumn("g", g).groupBy(key, "g").agg(F.min("window_start").alias("s"), F.max("window_end").alias("window_end"), F.max(F.col("ok").cast("int")).alias("done")).where("done = 1")
    last = F.lag("window_end").over(Window.partitionBy(key).orderBy("g"))
    return spans.select(key, "g", F.coalesce(last, "s").alias("window_start"), "window_end")


def flushed(observed: DataFrame, closes: DataFrame, key: str = "daemon") -> DataFrame:
    """Counts (key, metric, window_start, window_end, n) that the flushes emit, from observed (key, metric, i, n), ``i`` the
    close that the samples came before."""
    order = Window.partitionBy(key).orderBy("i")
    g = F.coalesce(F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    turn = closes.select(key, "i", g.alias("g"))
    return observed.join(turn, [key, "i"]).groupBy(key, "g", "metric").agg(F.sum("n").alias("n")).join(flushes(closes, key), [key, "g"]).select(key, "metric", "window_start", "window_end", "n")
