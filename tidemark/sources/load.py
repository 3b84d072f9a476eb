"""Load: synthetic writes and queries at a rate, and what they report."""

from __future__ import annotations

import socket
import socketserver
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import Frames, decode_message, encode_message, frame
from tidemark.operators import analysis
from tidemark.sources.observations import synthetic

EVENTS = "kind string, ts double, worker_id long, query_id long"


class RateLimiter:
    """At most ``most`` passes in each second that begins with a pass."""

    def __init__(self, most: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.most, self.clock, self.sleep = most, clock, sleep
        self.opened, self.passed = None, 0

    def wait(self) -> None:
        """Return when the next pass is due."""
        now = self.clock()
        if self.opened is None or now - self.opened >= 1:
            self.opened, self.passed = now, 0
        elif self.passed >= self.most:
            self.sleep(self.opened + 1 - now)
            self.opened, self.passed = self.clock(), 0
        self.passed += 1


def retry(send: Callable[[], object], sleep: Callable[[float], None] = time.sleep, tries: int | None = None, on_state: Callable[[bool], None] = lambda ok: None):
    """Call ``send`` until it doesn't raise an OSError, after pauses of 10 ms that double up to 4096 times that. ``on_state``
    hears of each failure and success, as a circuit does. Without ``tries`` it never gives up."""
    n = 0
    while True:
        try:
            out = send()
        except OSError:
            on_state(False)
            n += 1
            if tries is not None and n >= tries:
                raise
            sleep(0.01 * 2 ** min(n - 1, 12))
        else:
            on_state(True)
            return out


def writes(spark: SparkSession, metrics: int, windows: int, size: int, start: int, seconds: int, seed: int = 0) -> DataFrame:
    """Synthetic observations of ``metrics`` metrics ``load.<k>``, each with ``windows`` windows of ``size`` values."""
    specs = spark.range(metrics).select(F.concat(F.lit("load."), F.col("id").cast("string")).alias("name"), F.lit(windows).cast("long").alias("count"))
    return synthetic(spark, specs, start, seconds, size, seed)


def drive(engine, queries: Iterable[str], limiter: RateLimiter, worker: int = 0, clock: Callable[[], float] = time.time) -> Iterator[tuple]:
    """Run the queries at the limiter's rate; events (kind, ts, worker_id, query_id) of each: sent, received, or error."""
    for k, text in enumerate(queries):
        limiter.wait()
        yield "sent", clock(), worker, k
        try:
            next(engine.query(text).toLocalIterator(), None)
            yield "received", clock(), worker, k
        except Exception:
            yield "error", clock(), worker, k


def report(events: DataFrame, seconds: int) -> DataFrame:
    """(kind, interval, n, rate) of each kind's closed report intervals, from (kind, ts, ...)."""
    cut = analysis.report_intervals(events, seconds, "kind")
    span = F.greatest(F.floor(F.max("ts") - F.min("ts")), F.lit(1)).cast("double")
    return cut.groupBy("kind", "interval").agg(F.count("*").alias("n"), (F.count("*") / span).alias("rate"))


def waiting(events: DataFrame) -> DataFrame:
    """Per query: count, median, 95th percentile, least and greatest microseconds from sent to the first received."""
    e = events.where("kind IN ('sent', 'received')")
    e = e.select("worker_id", "query_id", F.round(F.col("ts") * 1_000_000).cast("long").alias("ts"), (F.col("kind") == "sent").alias("sent"), "kind")
    return analysis.stat_summary(analysis.latencies(e, ["sent"]), "query_id", F.col("duration"))


def report_lines(rows: DataFrame) -> DataFrame:
    """Report rows as lines of text, one field after the other; nulls are left out."""
    return rows.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in rows.columns]).alias("line"))


def send_windows(windows: DataFrame, host: str, port: int, timeout: float = 10) -> None:
    """Send exact stored windows as framed messages, one connection a partition; a failed partition is sent again whole."""

    def send(rows: Iterator[Row]) -> None:
        link = None
        for r in rows:
            link = link or retry(lambda: socket.create_connection((host, port), timeout), tries=12)
            values = np.repeat([h["value"] for h in r["hist"]], [h["weight"] for h in r["hist"]])
            link.sendall(frame(encode_message(r["metric"], r["window_start"], r["window_end"], values)))
        if link:
            link.close()

    windows.select("metric", "window_start", "window_end", "hist").foreachPartition(send)


def receive(address: tuple[str, int], folder: str) -> socketserver.ThreadingTCPServer:
    """A server that writes the observations of framed windows into files of a folder, one per connection, tab-separated as
    metric, window start and value; a file stream reads them (``spool``). A file appears when its connection ends well."""

    class Handler(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            frames, name = Frames(), uuid.uuid4().hex
            part = Path(folder) / f".{name}"
            with part.open("w") as f:
                while data := self.request.recv(1 << 16):
                    for body in frames.feed(data):
                        metric, start, _, values = decode_message(body)
                        f.writelines(f"{metric}\t{start}\t{v}\n" for v in values.tolist())
            if frames.held:
                part.unlink()
            else:
                part.rename(Path(folder) / name)

    Path(folder).mkdir(parents=True, exist_ok=True)
    return socketserver.ThreadingTCPServer(address, Handler)


def spool(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming observations of the files that ``receive`` writes."""
    return spark.readStream.schema("metric string, ts long, value long").option("sep", "\t").csv(folder)
