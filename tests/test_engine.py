"""Query, storage, downsampling, ingest and analysis goldens."""

import socket
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.names import is_name, literal_prefix, matches, valid_name
from tidemark.operators import analysis
from tidemark.operators.downsample import plan
from tidemark.operators.sketches import ExactTier, KllTier
from tidemark.operators.windows import islands
from tidemark.plans.planner import Engine
from tidemark.plans.server import serve
from tidemark.sources.observations import insert_specs, numbers, parse_lines, query_lines, synthetic, tasks
from tidemark.sources.store import DiskStore, MemoryStore
from tidemark.sources.udp import UdpReader
from tidemark.streaming.ingest import circuit, closed_windows, flush_into_store, flushed, flushes, into_store, windows

HUNDRED = list(range(100))


def stored(spark, rows, values=HUNDRED, tier=None):
    """Stored windows (metric, start, end), each with the values."""
    tier = tier or ExactTier()
    w = spark.createDataFrame([(m, s, e) for m, s, e in rows], "metric string, window_start long, window_end long")
    flat = w.select("*", F.explode(F.array(*[F.lit(v) for v in values]).cast("array<long>")).alias("value"))
    if isinstance(tier, KllTier):
        return flat.groupBy("metric", "window_start", "window_end").agg(F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.expr("kll_sketch_agg_bigint(value, 200)").alias("kll")).select("metric", "window_start", "window_end", "n", "vmin", "vmax", "kll")
    hist = F.array_sort(F.collect_list(F.struct("value", F.lit(1).cast("long").alias("weight")))).alias("hist")
    return flat.groupBy("metric", "window_start", "window_end").agg(F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), hist)


def ask(spark, rows, text, tier=None):
    tier = tier or ExactTier()
    return [tuple(r) for r in Engine(MemoryStore(tier, stored(spark, rows, tier=tier))).query(text).collect()]


FOUR = [("foo", 10, 20), ("foo", 20, 30), ("foo", 30, 40), ("foo", 40, 50)]
GOLDENS = [
    ([("foo", 1, 2), ("foo", 2, 3), ("bar", 3, 4)], 'quantile(fetch("foo"), 0.5)', [(1, 2, 0.5, 50), (2, 3, 0.5, 50)]),
    (FOUR[:2], 'quantile(fetch("foo"), 0.1, 0.5, 0.9)', [(10, 20, 0.1, 10), (10, 20, 0.5, 50), (10, 20, 0.9, 90), (20, 30, 0.1, 10), (20, 30, 0.5, 50), (20, 30, 0.9, 90)]),
    (FOUR, 'quantile(fetch("foo", 20, 40), 0.5)', [(20, 30, 0.5, 50), (30, 40, 0.5, 50)]),
    ([("foo", 1, 2)], 'quantile(fetch("bar"), 0.5)', []),
    ([*FOUR, ("foo", 4000, 4500)], 'quantile(group("hours", fetch("foo", 0, 10000)), 0.5)', [(10, 50, 0.5, 50), (4000, 4500, 0.5, 50)]),
    ([*FOUR[:2], ("foo", 7000, 8000), ("foo", 90000, 91000)], 'quantile(group("days", fetch("foo", 0, 100000)), 0.5)', [(10, 8000, 0.5, 50), (90000, 91000, 0.5, 50)]),
    ([("foo", 30, 60), ("foo", 15, 35)], 'quantile(coalesce(fetch("foo")), 0.5)', [(15, 60, 0.5, 50)]),
    ([("foo", 10, 20), ("foo", 40, 90)], 'quantile(coalesce(coalesce(fetch("foo"))), 0.5)', [(10, 90, 0.5, 50)]),
    ([("foo", 0, 30), ("foo", 30, 60), ("bar", 0, 30), ("bar", 30, 60)], 'quantile(combine(fetch("foo"), fetch("bar")), 0.5)', [(0, 30, 0.5, 50), (30, 60, 0.5, 50)]),
    ([("foo", 0, 30)], 'quantile(combine(fetch("foo"), fetch("bar")), 0.5)', [(0, 30, 0.5, 50)]),
    (
        [("foo", 10, 20), ("foo", 15, 30), ("foo", 40, 50), ("foo", 50, 60), ("foo", 60, 70), ("bar", 40, 50), ("bar", 55, 59), ("bar", 69, 80), ("bar", 90, 100)],
        'quantile(combine(fetch("foo"), fetch("bar")), 0.5)',
        [(10, 30, 0.5, 50), (40, 50, 0.5, 50), (50, 60, 0.5, 50), (60, 80, 0.5, 50), (90, 100, 0.5, 50)],
    ),
    # a bucket of combined windows is told by the combined start
    ([("foo", 3500, 3700), ("bar", 3650, 7300)], 'quantile(group("hours", combine(fetch("foo"), fetch("bar"))), 0.5)', [(3500, 7300, 0.5, 50)]),
]


@pytest.mark.parametrize("tier", [ExactTier(), KllTier()], ids=["exact", "kll"])
@pytest.mark.parametrize(("rows", "text", "expected"), GOLDENS)
def test_query_goldens(spark, tier, rows, text, expected):
    got = ask(spark, rows, text, tier)
    assert [r[:4:1][:3] for r in got] == [e[:3] for e in expected]
    slack = 0 if tier.name == "exact" else 3
    assert all(abs(r[4] - e[3]) <= slack for r, e in zip(got, expected))


def test_bounds_and_search(spark):
    got = ask(spark, [("foo", 0, 30)], 'quantile(fetch("foo"), 0.1, 0.5, 0.9, 0.29)')
    assert [(r[3], r[4], r[5], r[6]) for r in got] == [(100, 10, 7, 11), (100, 50, 47, 51), (100, 90, 87, 91), (100, 28, 25, 29)]
    names = [(m, 0, 1) for m in ("foo", "bar", "foobar", "bazbar", "bazfoobar")]
    assert ask(spark, names, 'search("*foo*r")') == [("bazfoobar",), ("foobar",)]
    lines = Engine(MemoryStore(ExactTier(), stored(spark, [("foo", 0, 30)]))).text('quantile(fetch("foo"), 0.5, 0.0001)')
    assert [r.line for r in lines.collect()] == ["start=0, end=30, phi=0.5, count=100, approx=50, lower=47, upper=51", "start=0, end=30, phi=0.0001, count=100, approx=0, lower=0, upper=99"]


def test_weighted_values_equal_expanded_ones(spark):
    weights = {2: 1, 4: 1, 6: 1, 7: 1, 1: 2, 3: 2, 5: 2}
    flat = sorted(v for v, w in weights.items() for _ in range(w))
    rows = ExactTier.frame(spark.createDataFrame([(0, v, w) for v, w in weights.items()], "wid long, value long, weight long"))
    phis = [k / 100 for k in range(1, 100)]
    got = {r.phi: r.approx for r in ExactTier().quantiles(rows, phis).collect()}
    assert got == {p: flat[int(len(flat) * p)] for p in phis}


def test_islands_across_days(spark):
    rows = [(0, 10), (5, 200_000), (100, 150), (190_000, 190_010), (200_000, 200_010), (400_000, 400_001)]
    got = {(r.window_start, r.window_end): r.island for r in islands(spark.createDataFrame(rows, "window_start long, window_end long")).collect()}
    assert got == {(0, 10): 0, (5, 200_000): 0, (100, 150): 0, (190_000, 190_010): 0, (200_000, 200_010): 200_000, (400_000, 400_001): 400_000}


def test_store(spark, tmp_path):
    tier = ExactTier()
    store = DiskStore(spark, tier, str(tmp_path / "db"))
    store.insert(stored(spark, [("foo", 0, 30)], [1, 2]))
    store.insert(stored(spark, [("foo", 0, 90), ("1bad", 0, 30)], [3]))
    engine = Engine(store)
    assert [tuple(r)[:5] for r in engine.query('quantile(fetch("foo"), 0.5)').collect()] == [(0, 90, 0.5, 3, 2)]
    scan = engine.plan('fetch("foo", 5, 50)').df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric,foo)" in scan and "GreaterThanOrEqual(window_start,5)" in scan and "LessThan(window_start,50)" in scan
    assert store.insert(stored(spark, [("bar", 7, 9)], [5]), writer="x", number=3)
    for number in (3, 2):
        assert not store.insert(stored(spark, [("bar", 7, 9)], [6]), writer="x", number=number)
    assert [r.approx for r in engine.query('quantile(fetch("bar"), 0.5)').collect()] == [5]
    store.downsample(100_000_000)
    assert store.windows().count() == 0
    assert not store.insert(stored(spark, [("bar", 7, 9)], [5]), writer="x", number=3) and store.windows().count() == 0
    assert [r.metric for r in engine.query('search("*")').collect()] == ["bar", "foo"]
    assert DiskStore(spark, tier, str(tmp_path / "db")).metrics().count() == 2
    store.destroy()
    assert not (tmp_path / "db").exists()


def test_inserts_during_a_downsampling_pass_stay(spark, tmp_path, monkeypatch):
    tier, path = ExactTier(), str(tmp_path / "db")
    store, other = DiskStore(spark, tier, path, keep_seconds=0), DiskStore(spark, tier, path)
    store.insert(stored(spark, [("foo", 1000, 1001), ("foo", 1005, 1006)], [1]))
    before = store.windows()
    put = store._put

    def slow(*args):
        batch = put(*args)
        other.insert(stored(spark, [("foo", 1000, 1001), ("late", 0, 1)], [2]))
        return batch

    monkeypatch.setattr(store, "_put", slow)
    assert store.downsample(1400)
    rows = sorted((r.metric, r.window_start, r.window_end, r.n) for r in tier.totals(store.windows()).collect())
    assert rows == [("foo", 1000, 1010, 3), ("late", 0, 1, 1)]
    assert {r.metric for r in other.metrics().collect()} == {"foo", "late"}
    # two passes at once: the one that commits last finds its batches gone and changes nothing
    monkeypatch.setattr(store, "_put", lambda *a: (other.downsample(1400), put(*a))[1])
    assert not store.downsample(1400)
    assert sum(r.n for r in tier.totals(store.windows()).collect()) == 4
    assert before is not None


def test_folding_keeps_all_rows_and_prunes_by_metric(spark, tmp_path, monkeypatch):
    tier = ExactTier()
    monkeypatch.setattr(DiskStore, "FAN", 3)
    store = DiskStore(spark, tier, str(tmp_path / "db"))
    for k in range(7):
        store.insert(stored(spark, [("m.a", 0, 1 + k), (f"m.{k}", k, k + 1)], [k]))
    assert len(store._state()[1]["batches"]) == 3
    assert sorted((r.metric, r.window_end, r.n) for r in tier.totals(store.windows()).collect()) == sorted([("m.a", 7, 7), *[(f"m.{k}", k + 1, 1) for k in range(7)]])
    plan = store.fetch("m.a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(metric,m.a)" in plan
    assert [r.metric for r in store.search("m.*").collect()] == sorted(["m.a", *[f"m.{k}" for k in range(7)]])


def test_hot_windows_are_bounded_rows_and_ranks_are_dealt_out(spark):
    tier = ExactTier()
    obs = spark.range(3 * model.SPAN).select(F.lit("m").alias("metric"), F.lit(0).cast("long").alias("ts"), (F.col("id") * 1000).alias("value"))
    obs = obs.where("id % 997 = 0")
    w = tier.windowize(obs, 10)
    assert w.count() > 1000 and tier.totals(w).count() == 1
    values = [k * 1000 for k in range(0, 3 * model.SPAN, 997)]
    values = [v for v in values if v <= model.MAX_VALUE]
    found = tier.quantiles(tier.open(w), [0.1, 0.5, 0.999])
    assert {r.phi: r.approx for r in found.collect()} == {p: values[int(len(values) * p)] for p in (0.1, 0.5, 0.999)}
    for text in ('quantile(coalesce(fetch("m")), 0.5)', 'quantile(fetch("m"), 0.5)', 'quantile(group("days", fetch("m")), 0.5)'):
        plan = Engine(MemoryStore(tier, w)).plan(text).df._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "Window [" in x and "value#" in x]
        assert lines and all("span#" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in lines)


def test_u64_bounds(spark):
    rows = [("foo", 1, 2), ("foo", 5, 6)]
    assert len(ask(spark, rows, f'quantile(fetch("foo", 0, {(1 << 64) - 1}), 0.5)')) == 2
    assert ask(spark, rows, f'quantile(fetch("foo", {1 << 63}), 0.5)') == []


def test_names(spark):
    good, bad = ["foo123", "foo.bar", "foo-bar", "foo_bar", "FooBar"], ["", "1", "1foo", "foo&bar", ".foo", "_foo", "-foo", "foo\n", None]
    rows = spark.createDataFrame([(x,) for x in good + bad], "name string").select("name", valid_name(F.col("name")).alias("ok")).collect()
    assert all(r.ok == (r.name in good) for r in rows)
    assert all(is_name(x) for x in good) and not any(is_name(x) for x in bad[:-1])
    names = spark.createDataFrame([(x,) for x in ("foo", "foobar", "bazta", "batter", "a_b", "a%b", "a!b", "")], "metric string")
    for pattern, expected in {"foo*": {"foo", "foobar"}, "*z*": {"bazta"}, "x*": set(), "foobar": {"foobar"}, "": {""}, "a_*": {"a_b"}, "a%b": {"a%b"}, "*!b": {"a!b"}, "b**r": {"batter"}}.items():
        assert {r.metric for r in names.where(matches(F.col("metric"), pattern)).collect()} == expected, pattern
    assert names.where(matches(F.col("metric"), "*")).count() == 8
    assert literal_prefix("foo*bar*") == "foo"


DOWN = [
    (3600, 3800, 4000, "ignore", 3800, 4000), (299, 0, 1, "ignore", 0, 1), (86399, 0, 10, "ignore", 0, 10), (604799, 0, 60, "ignore", 0, 60), (2419199, 0, 600, "ignore", 0, 600),
    (31535999, 0, 3600, "ignore", 0, 3600), (86399, 1, 9, "expand", 0, 10), (604799, 1, 59, "expand", 0, 60), (2419199, 1, 599, "expand", 0, 600), (31535999, 1, 3599, "expand", 0, 3600),
    (31536000, 0, 10, "discard", 0, 10), (2419199, 1, 1200, "expand", 0, 1200),
]


@pytest.mark.parametrize(("now", "start", "end", "action", "new_start", "new_end"), DOWN)
def test_downsample_plan(spark, now, start, end, action, new_start, new_end):
    r = plan(spark.createDataFrame([(start, end)], "window_start long, window_end long"), now).first()
    assert (r.action, r.new_start, r.new_end) == (action, new_start, new_end)


def test_statsd(spark, tmp_path):
    good = ["foo:1234|ms", "foo:12345|ms|@0.1", "region.us.server.abc:1|ms", "us-west:1|ms", "env_prod:1|ms", "FooBar:4294967295|ms"]
    bad = ["", "invalid", ":123|ms", "foo:|ms", "foo|ms", "foo:bar|ms", "foo|123|ms", "1foo:1|ms", ".foo:1|ms", "-foo:1|ms", "_foo:1|ms", " foo:1|ms", "foo:1|ms ", "foo:1|ms\n", "foo:4294967296|ms", "foo:99999999999999999999999|ms", "foo:1|ms|@1", None]
    got = parse_lines(spark.createDataFrame([(x,) for x in good + bad], "value string")).collect()
    assert sorted((r.metric, r.value) for r in got) == sorted((x.split(":")[0], int(x.split(":")[1].split("|")[0])) for x in good)
    (tmp_path / "n").write_text("1\nx\n\n-3\n4294967296\n7\n")
    assert [r.value for r in numbers(spark, str(tmp_path / "n")).collect()] == [1, 7]
    (tmp_path / "s").write_text("3 foo\nbad\nx y\n1 a b\n")
    specs = insert_specs(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in specs.collect()] == [("foo", 3), ("a b", 1)]
    made = synthetic(spark, specs.where("name = 'foo'"), 100, 30, 5).collect()
    assert len(made) == 15 and {r.ts for r in made} == {100, 130, 160} and all(0 <= r.value < 10_000 for r in made)
    assert query_lines(spark, str(tmp_path / "s"))[0] == "3 foo"


def test_synthetic_is_dealt_out(spark):
    """Neither one name nor one window is made by one task; windows are whole."""
    specs = spark.createDataFrame([("foo", 500_000), ("bar", 3), ("none", 0), ("null", None)], "name string, count long")
    for rows, size in ((specs, 5), (specs.where("name = 'bar'"), 1_000_000)):
        made = synthetic(spark, rows, 100, 30, size)
        by = made.groupBy("metric", "ts").agg(F.count("*").alias("n"))
        found = by.groupBy("metric").agg(F.count("*"), F.min("ts"), F.max("ts"), F.min("n"), F.max("n")).collect()
        assert sorted(tuple(r) for r in found) == [("bar", 3, 100, 160, size, size), ("foo", 500_000, 100, 15_000_070, 5, 5)][: rows.count() // 3 + 1]
        assert max(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()) <= model.SPAN
    assert tasks(specs, 5) == 3 and tasks(specs.where("count = 0"), 5) == 1
    assert synthetic(spark, specs, 100, 30, 0).count() == 0


def test_windowize_dealt_out_once(spark):
    tier = ExactTier()
    obs = spark.range(20_000).select(F.concat(F.lit("m"), F.col("id") % 3).alias("metric"), (F.col("id") % 700).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(3 * model.SPAN)).alias("value"))
    plain, dealt = (tier.windowize(obs, 10, tasks=n) for n in (None, 7))
    assert sorted(dealt.collect()) == sorted(plain.collect())
    assert dealt.columns == plain.columns and dealt.rdd.getNumPartitions() == 7


def test_window_tracker_and_circuit(spark):
    ticks = spark.createDataFrame([("d", t) for t in (0, 29, 30, 31, 60)] + [("e", t) for t in (12, 30)], "daemon string, now long")
    assert sorted(tuple(r) for r in closed_windows(ticks, 30).collect()) == [("d", 30, 0, 30), ("d", 60, 30, 60), ("e", 30, 0, 30)]
    rows = [("d", 1, 30, 60, False), ("d", 2, 60, 90, False), ("d", 3, 90, 120, True), ("d", 4, 150, 180, True), ("e", 1, 0, 30, False)]
    closes = spark.createDataFrame(rows, "daemon string, i long, window_start long, window_end long, ok boolean")
    assert sorted((r.daemon, r.window_start, r.window_end) for r in flushes(closes).collect()) == [("d", 30, 120), ("d", 120, 180)]
    seen = spark.createDataFrame([("d", "foo", 1, 1), ("d", "bar", 2, 1), ("d", "foo", 3, 1), ("d", "baz", 4, 2), ("e", "x", 1, 1)], "daemon string, metric string, i long, n long")
    assert sorted(tuple(r)[1:] for r in flushed(seen, closes).collect()) == [("bar", 30, 120, 1), ("baz", 120, 180, 2), ("foo", 30, 120, 2)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"foo:{v}|ms" for v in range(20)] + ["junk"]
    (tmp_path / "in/a").write_text("\n".join(lines))
    source = spark.readStream.text(str(tmp_path / "in"))
    obs = parse_lines(source).withColumn("ts", F.col("value") % 2 * 30)
    store = DiskStore(spark, ExactTier(), str(tmp_path / "db"))
    into_store(obs, store, 30, str(tmp_path / "progress")).awaitTermination()
    (tmp_path / "in/b").write_text("foo:100|ms")
    into_store(obs, store, 30, str(tmp_path / "progress")).awaitTermination()
    assert [(r.window_start, r["count"], r.upper) for r in Engine(store).query('quantile(fetch("foo"), 0.9)').collect()] == [(0, 11, 100), (30, 10, 19)]
    for tier, n in ((KllTier(), 1), (ExactTier(), 10)):
        q = windows(obs, 10, "5 seconds", tier).writeStream.format("memory").queryName(f"w_{tier.name}").outputMode("append").option("checkpointLocation", str(tmp_path / tier.name)).trigger(availableNow=True).start()
        q.awaitTermination()
        # the watermark is 25, so the window of 0 is closed and that of 30 is not
        rows = tier.totals(spark.table(f"w_{tier.name}")).collect()
        assert spark.table(f"w_{tier.name}").count() in (n, n + 1)
        assert [(r.window_start, r.window_end, r.n, r.vmin, r.vmax) for r in rows] == [(0, 10, 11, 0, 100)]
    closed = DiskStore(spark, ExactTier(), str(tmp_path / "db2"))
    for _ in range(2):
        flush_into_store(obs, closed, 10, str(tmp_path / "c3"), "5 seconds").awaitTermination()
    (tmp_path / "in/c").write_text("foo:201|ms\nbar:7|ms")
    flush_into_store(obs.withColumn("ts", F.when(F.col("value") > 200, 300).otherwise(F.col("ts"))), closed, 10, str(tmp_path / "c3"), "5 seconds").awaitTermination()
    assert sorted((r.metric, r.window_start, r.n) for r in ExactTier().totals(closed.windows()).collect()) == [("bar", 30, 1), ("foo", 0, 11), ("foo", 30, 10)]


def test_streamed_circuit(spark, tmp_path):
    """Closes that fail, fail and succeed, over three micro-batches; then one without samples, then one with."""
    ends = {1: (30, 60, False), 2: (60, 90, False), 3: (90, 120, True), 4: (120, 150, True), 5: (150, 180, True)}
    samples = {1: ["foo", "bar"], 2: ["baz"], 3: ["bat", "foo"], 5: ["foo"]}
    schema = "daemon string, i long, metric string, n long, window_start long, window_end long, ok boolean"
    for k, own in enumerate(([1], [2, 3], [4, 5])):
        rows = [("d", i, None, None, *ends[i]) for i in own] + [("d", i, m, 1, None, None, None) for i in own for m in samples.get(i, [])]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
    got = []
    flushes = circuit(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    flushes.writeStream.foreachBatch(lambda b, n: got.append((n, sorted(tuple(r)[1:] for r in b.collect())))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [x for _, x in sorted(got)][:3] == [[], [("bar", 30, 120, 1), ("bat", 30, 120, 1), ("baz", 30, 120, 1), ("foo", 30, 120, 2)], [("foo", 150, 180, 1)]]


def test_udp_and_server(spark, tmp_path):
    reader = UdpReader({"port": "0"})
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    port = reader.socket.getsockname()[1]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"foo:1|ms", ("127.0.0.1", port))
    rows, end = reader.read(start)
    assert list(rows) == [("foo:1|ms",)] and list(reader.readBetweenOffsets(start, end)) == [("foo:1|ms",)]
    reader.commit(end)
    assert reader.kept == {}
    spooled = UdpReader({"port": "0", "spool": str(tmp_path / "spool")})
    spooled._keep(4, ["a", "b"])
    again = UdpReader({"port": "0", "spool": str(tmp_path / "spool")})
    assert list(again.readBetweenOffsets({"batch": 4}, {"batch": 5})) == [("a",), ("b",)]
    again.commit({"batch": 5})
    assert not list((tmp_path / "spool").glob("*.json"))
    with serve(Engine(MemoryStore(ExactTier(), stored(spark, [("foo", 0, 30)]))), ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        for text, reply in (('search("*")', "foo\n"), ("fetch()", "[ERROR] MissingArg(fetch: argument 1)\n")):
            with socket.create_connection(server.server_address) as c:
                c.sendall(text.encode())
                c.shutdown(socket.SHUT_WR)
                assert c.makefile().read() == reply
        server.shutdown()


def test_analysis(spark):
    for copies, expected in ((1, {0: 0.5, 5: 0.0, 9: 0.4}), (2, {1: 0.35, 4: 0.05, 5: 0.0, 6: 0.1})):
        values = spark.createDataFrame([("m", v) for v in range(10) for _ in range(copies)], "metric string, value long")
        probes = spark.createDataFrame([("m", 0.5, v) for v in expected], "metric string, phi double, approx long")
        got = {r.approx: r.error for r in analysis.rank_error(values, probes, ["metric"]).collect()}
        assert got == pytest.approx(expected)
    samples = spark.createDataFrame([("a", v) for v in range(100)] + [("b", None)], "k string, v long")
    assert [tuple(r) for r in analysis.stat_summary(samples, "k", F.col("v")).collect()] == [("a", 100, 50, 95, 0, 99)]
    ticks = spark.createDataFrame([("x", t) for t in (0, 2, 3, 4, 5)], "k string, ts long")
    assert [tuple(r) for r in analysis.rates(ticks, "k").collect()] == [("x", 1.0)]
    events = spark.createDataFrame([(1, 1, 0, True, 0), (1, 1, 11_000_000_022, False, 1), (1, 1, 23_000_000_000, False, 2), (2, 1, 5, True, 3)], "worker_id long, query_id long, ts long, sent boolean, id long")
    assert [tuple(r) for r in analysis.latencies(events, ["id"]).collect()] == [(1, 1, 11_000_000_022)]
    times = [0.0, 50e-9, 1.0, 1.00000005, 1.00000006, 1.00000007, 2.0]
    report = analysis.report_intervals(spark.createDataFrame([("r", t) for t in times], "report string, ts double"), 1)
    assert sorted((r.interval, r["count"]) for r in report.groupBy("interval").count().collect()) == [(0, 2), (1, 4)]
    counted = analysis.counts(ticks.withColumnRenamed("k", "name"), ["x", "y"], 3, 0, 6).collect()
    assert sorted(tuple(r) for r in counted) == [(0, "x", 2), (0, "y", 0), (3, "x", 3), (3, "y", 0)]


@pytest.mark.parametrize("n", [2048, 204_800])
def test_kll_error(spark, n):
    tier, phis = KllTier(), [k / 10 for k in range(1, 10)]
    values = spark.range(n).select(F.col("id").alias("value"))
    one = tier.quantiles(tier.open(tier.windowize(values.select(F.lit("m").alias("metric"), F.lit(0).cast("long").alias("ts"), "value"), 1)), phis)
    many = tier.quantiles(analysis.partition_and_merge(tier, values, 30), phis)
    for found in (one, many):
        assert all(r["count"] == n and abs(r.approx - int(n * r.phi)) <= 0.02 * n and r.lower <= r.approx <= r.upper for r in found.collect())
    exact = analysis.error_summary(ExactTier(), values, phis).collect()
    assert len(exact) == 9 and all(r.error == 0 for r in exact)


def test_values_out_of_range_and_empty(spark):
    tier = ExactTier()
    rows = spark.createDataFrame([("m", 1, -1), ("m", 1, model.MAX_VALUE + 1), ("m", 1, model.MAX_VALUE), (None, 1, 1), ("m", None, 1), ("m", 1, None)], model.OBSERVATION_SCHEMA)
    assert [(r.n, r.vmax) for r in tier.windowize(rows, 10).collect()] == [(1, model.MAX_VALUE)]
    assert tier.windowize(rows.where("false"), 10).count() == 0
