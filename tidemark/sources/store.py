"""The metric store: stored windows and metric names.

A store on disk is a folder of batches and a log. Every change is a new version of the log, a small file that lists the
batches that count; it appears whole or not at all, and only one writer gets a version's number. So readers see whole
changes, what is inserted while batches are folded stays, and a stream's batch that runs again is known by its number.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import is_name, matches, valid_name
from tidemark.model import METRIC_SCHEMA, InvalidMetricName, StoreConflict
from tidemark.operators.downsample import downsample

_MOST = (1 << 63) - 1


class MemoryStore:
    """A store over two DataFrames."""

    def __init__(self, tier, windows: DataFrame, metrics: DataFrame | None = None) -> None:
        self.tier, self._windows, self._metrics = tier, windows, metrics

    def windows(self) -> DataFrame:
        """Stored rows; the same key may occur more than once."""
        return self._windows

    def metrics(self) -> DataFrame:
        """Every metric ever inserted."""
        return self._metrics if self._metrics is not None else self.windows().select("metric").distinct()

    def _of(self, metric: str) -> DataFrame:
        return self.windows().where(F.col("metric") == metric)

    def fetch(self, metric: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Frame of a metric's windows that start in [start, end). Bounds have 64 unsigned bits; stored starts lie below
        2**63, so a start beyond finds nothing and an end beyond bounds nothing."""
        if not is_name(metric):
            raise InvalidMetricName(metric)
        rows = self._of(metric)
        if start is not None:
            rows = rows.where(F.lit(False) if start > _MOST else F.col("window_start") >= start)
        if end is not None and end <= _MOST:
            rows = rows.where(F.col("window_start") < end)
        return self.tier.open(rows)

    def search(self, pattern: str) -> DataFrame:
        """Metric names that match, ascending."""
        return self.metrics().where(matches(F.col("metric"), pattern)).select("metric").distinct().orderBy("metric")


class DiskStore(MemoryStore):
    """A store in a folder of any file system that Spark writes to.

    A batch has a level: an insert's is 0, and ``fold`` of FAN batches of one level makes one of the next. Batches from
    level 1 on are split by a hash of the metric into BUCKETS folders, so a fetch reads its metric's bucket of them and at
    most FAN - 1 small batches besides. ``keep_seconds``: how long batches that no longer count stay for readers under way.
    """

    FAN = 16
    BUCKETS = 32

    def __init__(self, spark: SparkSession, tier, path: str, keep_seconds: int = 86_400) -> None:
        self.spark, self.tier, self.path, self.keep = spark, tier, path.rstrip("/"), keep_seconds
        jvm = spark._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs_path(self.path).toUri(), conf)
        if self._version() is None:
            self._write(0, {"batches": {}, "writers": {}, "gone": {}})

    # the log

    def _version(self) -> int | None:
        log = self._fs_path(f"{self.path}/log")
        if not self._fs.exists(log):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)

    def _state(self) -> tuple[int, dict]:
        version = self._version()
        stream = self._fs.open(self._fs_path(f"{self.path}/log/{version:012d}.json"))
        try:
            return version, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, version: int, state: dict) -> bool:
        """Whether this writer got the version's number."""
        part = self._fs_path(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(part, self._fs_path(f"{self.path}/log/{version:012d}.json"), none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def _commit(self, change: Callable[[dict], bool], tries: int = 100) -> bool:
        """Apply ``change`` to the newest state until its version is ours; it says whether there is anything to commit."""
        for _ in range(tries):
            version, state = self._state()
            if not change(state):
                return False
            if self._write(version + 1, state):
                self._clean(version)
                return True
        raise StoreConflict(self.path)

    def _clean(self, version: int) -> None:
        """Delete versions of the log long past."""
        for n in range(version - 50, version - 55, -1):
            if n >= 0:
                self._fs.delete(self._fs_path(f"{self.path}/log/{n:012d}.json"), False)

    # reading

    def _read(self, part: str, schema: str, state: dict, where=None) -> DataFrame:
        names = state["batches"]
        low = [f"{self.path}/{b}/{part}" for b, level in names.items() if not level]
        high = [f"{self.path}/{b}/{part}" for b, level in names.items() if level]
        parts = [self.spark.createDataFrame([], schema)] if not names else []
        if low:
            parts.append(self.spark.read.schema(schema).parquet(*low))
        for path in high if part == "windows" else []:
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(path)
            parts.append((rows if where is None else rows.where(where)).drop("bucket"))
        if high and part == "names":
            parts.append(self.spark.read.schema(schema).parquet(*high))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def windows(self) -> DataFrame:
        return self._read("windows", self.tier.schema, self._state()[1])

    def _of(self, metric: str) -> DataFrame:
        bucket = F.col("bucket") == _bucket(F.lit(metric), self.BUCKETS)
        return self._read("windows", self.tier.schema, self._state()[1], bucket).where(F.col("metric") == metric)

    def metrics(self) -> DataFrame:
        return self._read("names", METRIC_SCHEMA, self._state()[1]).distinct()

    # writing

    def _put(self, windows: DataFrame, names: DataFrame | None, level: int) -> str:
        batch = f"batch-{level}-{uuid.uuid4().hex}"
        if level:
            # a bucket that is too large for one task is split at run time
            dealt = windows.withColumn("bucket", _bucket(F.col("metric"), self.BUCKETS)).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", "metric", "window_start").write.partitionBy("bucket").parquet(f"{self.path}/{batch}/windows")
        else:
            windows.sortWithinPartitions("metric", "window_start").write.parquet(f"{self.path}/{batch}/windows")
        if names is None:
            names = self.spark.read.schema(self.tier.schema).parquet(f"{self.path}/{batch}/windows")
        names.select("metric").distinct().write.parquet(f"{self.path}/{batch}/names")
        return batch

    def insert(self, windows: DataFrame, writer: str | None = None, number: int = 0) -> bool:
        """Add stored windows; those of a key already there are merged with it. Rows with an invalid name are dropped.

        A named ``writer`` counts its inserts by ``number``: one that is not above the last is known and does nothing,
        whatever has been folded since, so retries do no harm. Names become visible together with their windows. The
        result says whether anything was inserted.
        """
        if writer is not None and self._state()[1]["writers"].get(writer, -1) >= number:
            return False
        rows = windows.where(valid_name(F.col("metric")) & (F.col("window_start") < F.col("window_end")))
        batch = self._put(rows, None, 0)

        def add(state: dict) -> bool:
            if writer is not None:
                if state["writers"].get(writer, -1) >= number:
                    return False
                state["writers"][writer] = number
            state["batches"][batch] = 0
            return True

        done = self._commit(add)
        if not done:
            self._drop([batch])
        self.fold()
        return done

    def _replace(self, old: list[str], new: str, now: float) -> bool:
        """Put ``new`` in the place of ``old``; not if another writer has replaced one of them meanwhile."""

        def change(state: dict) -> bool:
            if any(b not in state["batches"] for b in old):
                return False
            for b in old:
                del state["batches"][b]
                state["gone"][b] = now
            state["batches"][new] = int(new.split("-")[1])
            return True

        done = self._commit(change)
        if not done:
            self._drop([new])
        self._expire(now)
        return done

    def _expire(self, now: float) -> None:
        old: list[str] = []

        def change(state: dict) -> bool:
            old[:] = [b for b, since in state["gone"].items() if now - since >= self.keep]
            for b in old:
                del state["gone"][b]
            return bool(old)

        if self._commit(change):
            self._drop(old)

    def _drop(self, batches: list[str]) -> None:
        for b in batches:
            self._fs.delete(self._fs_path(f"{self.path}/{b}"), True)

    def fold(self) -> None:
        """Merge the batches of every level that has FAN or more into one of the next level."""
        while True:
            _, state = self._state()
            levels = sorted(state["batches"].values())
            level = next((n for n in levels if levels.count(n) >= self.FAN), None)
            if level is None:
                return
            old = [b for b, n in state["batches"].items() if n == level]
            part = {"batches": {b: level for b in old}}
            merged = self.tier.merge_stored(self._read("windows", self.tier.schema, part))
            if not self._replace(old, self._put(merged, self._read("names", METRIC_SCHEMA, part), level + 1), time.time()):
                return

    def downsample(self, now: int) -> bool:
        """Coarsen and discard by age, in all batches that are there when it begins; names stay searchable. What is inserted
        meanwhile stays as it is until the next pass. The result says whether the pass took effect."""
        _, state = self._state()
        old = list(state["batches"])
        if not old:
            return False
        level = max(1, *state["batches"].values())
        rows = downsample(self.tier, self._read("windows", self.tier.schema, state), now)
        return self._replace(old, self._put(rows, self._read("names", METRIC_SCHEMA, state), level), time.time())

    def destroy(self) -> None:
        """Delete the store."""
        self._fs.delete(self._fs_path(self.path), True)


def _bucket(metric, buckets: int):
    return F.pmod(F.xxhash64(metric), F.lit(buckets)).cast("int")
