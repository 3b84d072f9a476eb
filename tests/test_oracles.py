"""Every query with SQL equals DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import oracles, queries


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.SQL)
    assert set(oracles.SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    r = db.execute(oracles.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)

    def order(row):
        return [(x is None, str(x)) for x in row]

    assert sorted((tuple(x[n] for n in names) for x in df.collect()), key=order) == sorted(r.fetchall(), key=order)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder of tables with so many distinct values in several files that sketches of them differ from run to run."""
    d = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(0, 160_000, 1, 4).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(10_000_000)) / 100)
    ts = F.timestamp_seconds(1_704_067_200 + F.col("id") % 172_800).cast("timestamp_ntz")
    kind = F.when(F.xxhash64("id", F.lit("kind")) % 2 == 0, "click").otherwise("view")
    rows.select(F.col("id").alias("event_id"), ts.alias("ts"), F.col("id").alias("user_id"), kind.alias("event_type"), F.col("at").alias("value")).write.parquet(f"{d}/events.parquet")
    flag = F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.pmod(F.xxhash64("id", F.lit("flag")), F.lit(3)) + 1).cast("int"))
    day = F.timestamp_seconds(1_704_067_200 + F.pmod(F.xxhash64("id", F.lit("day")), F.lit(50 * 86_400))).cast("timestamp_ntz")
    rows.select(flag.alias("l_returnflag"), day.alias("l_shipdate"), F.col("at").alias("l_extendedprice")).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["kll_combine", "kll_group", "kll_merge", "kll_quantile"])
def test_sketches_of_many_values_equal_sql(spark, many, name):
    c = duckdb.connect()
    for p in glob.glob(f"{many}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}/*.parquet'")
    r = c.execute(oracles.SQL[name])
    # as many parts as a large table has, so that merging them is left to chance
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = queries.QUERIES[name](spark, many).select(*[d[0] for d in r.description]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(tuple(x) for x in got) == sorted(r.fetchall())
