"""Bytes, frames, rates, retries and load."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import codec
from tidemark.operators import analysis
from tidemark.operators.sketches import ExactTier
from tidemark.plans.planner import Engine
from tidemark.sources import load
from tidemark.sources.store import MemoryStore


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_sorted_values(n):
    rng = np.random.default_rng(n)
    for top in (1, 200, 70_000, 1 << 20, 1 << 32):
        v = np.sort(rng.integers(0, top, n))
        data = codec.encode_sorted(v)
        back, read = codec.decode_sorted(data + b"more")
        assert (back == v).all() and read == len(data)
        d = np.diff(v, prepend=0)
        assert len(data) == 8 + n // 4 + 4 * (n % 4) + sum(1 + (x >= 256) + (x >= 1 << 16) + (x >= 1 << 24) for x in d[: n // 4 * 4])


def test_bad_bytes():
    for bad in (b"", b"1234567", (5).to_bytes(8, "little"), (1 << 40).to_bytes(8, "little"), codec.encode_sorted(np.arange(9))[:-1]):
        with pytest.raises(model.CodecError):
            codec.decode_sorted(bad)
    for values in ([2, 1], [-1], [1 << 32]):
        with pytest.raises(model.CodecError):
            codec.encode_sorted(np.array(values))
    with pytest.raises(model.CodecError):
        codec.Reader(codec.Writer().window(2, 1).done()).window()
    with pytest.raises(model.CodecError):
        codec.Reader(codec.Writer().uint(1).raw(b"\xff").done()).text()
    with pytest.raises(model.CodecError):
        codec.Writer().uint(1 << 64)
    with pytest.raises(model.CodecError):
        codec.Frames(most=4).feed(codec.frame(b"12345"))


def test_messages_and_frames():
    body = codec.encode_message("web.é", 10, 20, np.array([1, 1, 7]))
    metric, start, end, values = codec.decode_message(body)
    assert (metric, start, end, values.tolist()) == ("web.é", 10, 20, [1, 1, 7])
    w = codec.Writer().uint(7, 1).double(0.5).text("").sorted(np.arange(3)).done()
    r = codec.Reader(w)
    assert (r.uint(1), r.double(), r.text(), r.sorted().tolist()) == (7, 0.5, "", [0, 1, 2])
    stream, frames, got = codec.frame(body) + codec.frame(b"") + codec.frame(b"xy"), codec.Frames(), []
    for k in range(0, len(stream), 3):
        got += frames.feed(stream[k : k + 3])
    assert got == [body, b"", b"xy"] and frames.held == b""


def test_limiter_and_retry():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = load.RateLimiter(2, lambda: now[0], sleep)
    for _ in range(5):
        limiter.wait()
        now[0] += 0.25
    assert slept == [0.5, 0.5]
    left, heard, slept[:] = [15], [], []

    def send():
        left[0] -= 1
        if left[0] >= 0:
            raise ConnectionError
        return "sent"

    assert load.retry(send, slept.append, on_state=heard.append) == "sent"
    assert slept == [0.01 * 2 ** min(k, 12) for k in range(15)] and heard == [False] * 15 + [True]
    left[0] = 5
    with pytest.raises(ConnectionError):
        load.retry(send, slept.append, tries=2)


def test_load_reports(spark):
    tier = ExactTier()
    obs = load.writes(spark, 2, 3, 10, 0, 30)
    assert obs.count() == 60 and {r.metric for r in obs.select("metric").distinct().collect()} == {"load.0", "load.1"}
    engine, now = Engine(MemoryStore(tier, tier.windowize(obs, 30))), [0.0]

    def clock():
        now[0] += 0.5
        return now[0]

    events = list(load.drive(engine, ['search("*")', "nothing()"], load.RateLimiter(100, lambda: 0.0), clock=clock))
    assert [(e[0], e[3]) for e in events] == [("sent", 0), ("received", 0), ("sent", 1), ("error", 1)]
    rows = spark.createDataFrame(events, load.EVENTS)
    assert [tuple(r) for r in load.waiting(rows).collect()] == [(0, 1, 500_000, 500_000, 500_000, 500_000)]
    ticks = spark.createDataFrame([("sent", float(t), 0, 0) for t in range(7)], load.EVENTS)
    found = load.report(ticks, 3)
    assert sorted(tuple(r) for r in found.collect()) == [("sent", 0, 3, 1.5), ("sent", 1, 3, 1.5)]
    assert "kind=sent, interval=0, n=3, rate=1.5" in {r.line for r in load.report_lines(found).collect()}


def test_framed_windows_arrive(spark, tmp_path):
    tier = ExactTier()
    obs = spark.createDataFrame([("a", 5, 3), ("a", 6, 3), ("b", 31, 9)], model.OBSERVATION_SCHEMA)
    sent = tier.windowize(obs, 10)
    with load.receive(("127.0.0.1", 0), str(tmp_path / "in")) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        load.send_windows(sent, *server.server_address)
        server.shutdown()
    q = load.spool(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("framed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("framed").collect()) == [("a", 0, 3), ("a", 0, 3), ("b", 30, 9)]


def test_report_intervals_of_batches(spark):
    """Against the plain recurrence, over keys that span many Arrow batches, with ties and nulls."""
    rng = np.random.default_rng(1)
    rows = [(f"k{rng.integers(3)}", float(t)) for t in np.round(rng.uniform(0, 500, 3000), 1)] + [(None, 1.0), ("k0", None), ("once", 3.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = analysis.report_intervals(spark.createDataFrame(rows, "report string, ts double").withColumn("x", F.lit(1)), 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = []
    for key in ("k0", "k1", "k2"):
        number, opened, out = 0, None, []
        for t in sorted(t for k, t in rows if k == key and t is not None):
            opened = t if opened is None else opened
            if t - opened >= 7:
                number, opened = number + 1, t
            out.append((key, t, 1, number))
        expected += [x for x in out if x[3] < number]
    assert sorted(tuple(r) for r in found) == sorted(expected)
