"""Where observations come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import NAME
from tidemark.functions.time import div
from tidemark.model import MAX_VALUE, SPAN

#: Fixed value: a timer line; the sample rate is allowed and ignored.
LINE = rf"\A({NAME}):([0-9]+)[|]ms([|]@[0-9]+[.][0-9]+)?\z"
#: Values that are made from one row of a plan.
_BLOCK = SPAN // 16


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(metric, value) and all other columns of statsd timer lines; others, and values beyond 32 unsigned bits, are dropped."""
    rest = [c for c in lines.columns if c != column]
    line = F.col(column)
    value = F.regexp_extract(line, LINE, 2).try_cast("long")
    rows = lines.where(line.rlike(LINE)).select(*rest, F.regexp_extract(line, LINE, 1).alias("metric"), value.alias("value"))
    return rows.where(F.col("value").between(0, MAX_VALUE))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as observations ``events.<type>`` in hundredths, with its ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", "user_id", "event_type", F.concat(F.lit("events."), "event_type").alias("metric"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"),
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations ``ship.<flag>`` of their price in cents."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.concat(F.lit("ship."), "l_returnflag").alias("metric"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"),
    )


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """One 32-bit unsigned integer a line; other lines are skipped."""
    rows = spark.read.text(path).select(F.when(F.col("value").rlike(r"\A\+?[0-9]+\z"), F.col("value")).try_cast("long").alias("value"))
    return rows.where(F.col("value").between(0, MAX_VALUE))


def insert_specs(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``COUNT NAME`` as (name, count); malformed lines are skipped."""
    parts = F.split("value", " ", 2)
    rows = spark.read.text(path).select(F.get(parts, 1).alias("name"), F.get(parts, 0).try_cast("long").alias("count"))
    return rows.where("name IS NOT NULL AND count >= 0")


def query_lines(spark: SparkSession, path: str) -> list[str]:
    """The queries of a small text file, one a line."""
    return [r["value"] for r in spark.read.text(path, wholetext=False).collect()]


def tasks(specs: DataFrame, size: int) -> int:
    """How many tasks make or sum up the synthetic values of (name, count), SPAN values each; the specs are read at once."""
    return int(specs.where("count > 0").agg(F.ceil(F.sum(F.col("count").cast("long") * size) / SPAN)).first()[0] or 1)


def synthetic(spark: SparkSession, specs: DataFrame, start: int, seconds: int, size: int, seed: int = 0, most: int | None = None) -> DataFrame:
    """Observations for (name, count): the i-th window of a name begins at start + i * seconds and has ``size`` uniform
    values below 10000. Values are made in blocks, which are dealt out to ``most`` tasks (default: ``tasks``), so that
    neither a name nor a window is made in one."""
    sizes = specs.select("name", (F.col("count").cast("long") * size).alias("total")).where("total > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(_BLOCK).cast("long")))
    blocks = sizes.select("name", "total", first.alias("first")).repartition(most or tasks(specs, size))
    rows = blocks.select("name", F.explode(F.sequence("first", F.least(F.col("first") + _BLOCK, F.col("total")) - 1)).alias("k"))
    return rows.select(F.col("name").alias("metric"), (F.lit(start) + div(F.col("k"), size) * seconds).alias("ts"), F.floor(F.rand(seed) * 10_000).cast("long").alias("value"))
